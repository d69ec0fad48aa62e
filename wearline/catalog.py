"""Every query by name: (spark, folder of inputs) -> DataFrame."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.constants import FEATURES, SENSORS, STATION_KEYS
from wearline.operators import clean, compare, episodes, recurrence, scoring, security, sketches, windows
from wearline.operators.metrics import MAINTENANCE, RISK, WORK_ORDERS, with_station
from wearline.operators.recent import trailing
from wearline.plans import evaluation, exposure, maintenance, observability, training, value, work_orders
from wearline.plans.site import Site, open_site
from wearline.session import scratch
from wearline.sources import layout
from wearline.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Callable[[Site], DataFrame]] = {}

INJECTED_AT = datetime(2024, 1, 1, 0, 1, 0)
REPAIRED_AT = datetime(2024, 1, 1, 0, 3, 0)
STATION = "P1-A04"
PLANT = "Plant 1"
LINE = "P2-B"
CUSTOMER = "Helio Motors"
DAY = 86400


def _prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def query(build: Callable[[Site], DataFrame]) -> Callable[[Site], DataFrame]:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    def bind(build: Callable[[Site], DataFrame]) -> Query:
        def run(spark: SparkSession, inputs: str) -> DataFrame:
            _prepare(spark)
            return build(open_site(spark, inputs))

        return run

    return {name: bind(build) for name, build in _QUERIES.items()}


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_AVERAGES = tuple(f"avg_{s}" for s in SENSORS)


# -- readings, windows, risk -------------------------------------------------------------------------------------

@query
def bronze_telemetry(s: Site) -> DataFrame:
    return s.raw("sensor_readings")


@query
def dedup(s: Site) -> DataFrame:
    return clean.dedup(s.raw("sensor_readings"))


@query
def expectations_drop(s: Site) -> DataFrame:
    known = clean.normalize(clean.dedup(s.raw("sensor_readings")), s.raw("station_master"))
    return observability.rule_counts({
        "readings": (known, clean.VALID_READING),
        "windows": (windows.paned_window_features(s.table("readings_clean")), clean.COMPLETE_WINDOW),
        "requests": (s.raw("work_order_requests").withColumn("status", F.lit("open")), clean.WORK_ORDER_DOMAIN),
        "commands": (s.raw("commands"), clean.COMMAND_DOMAIN),
    })


@query
def expectations_warn(s: Site) -> DataFrame:
    rule = clean.not_from_future("TIMESTAMP '2024-01-01 00:01:00'")
    return rule.summary(clean.dedup(s.raw("sensor_readings")), "readings")


@query
def normalize(s: Site) -> DataFrame:
    scaled = clean.normalize(s.raw("sensor_readings"), s.raw("station_master"))
    names = [f"{x}_n" for x in SENSORS]
    return _round(scaled.select("event_id", "ts", *STATION_KEYS, *names), 6, *names)


@query
def window_features(s: Site) -> DataFrame:
    return _round(s.windows(), 6, *FEATURES, *_AVERAGES)


@query
def window_features_direct(s: Site) -> DataFrame:
    return _round(s.windows(windows.window_features), 6, *FEATURES, *_AVERAGES)


@query
def complete_windows(s: Site) -> DataFrame:
    complete = clean.COMPLETE_WINDOW.drop(s.windows())
    return complete.select("station_id", "window_start", "window_end", "n_readings", "last_reading_ts")


@query
def top_signal(s: Site) -> DataFrame:
    return s.scores().select("station_id", "window_end", "top_signal", "top_signal_deviation_pct")


@query
def risk_scores(s: Site) -> DataFrame:
    return _round(s.scores(), 6, *FEATURES, *_AVERAGES)


@query
def station_health_current(s: Site) -> DataFrame:
    return _round(s.health(), 6, *FEATURES, *_AVERAGES)


# -- maintenance -------------------------------------------------------------------------------------------------

@query
def maintenance_events(s: Site) -> DataFrame:
    return s.maintenance().withColumn("event_date", F.col("event_date").cast("string"))


@query
def maintenance_events_view(s: Site) -> DataFrame:
    """The stored view after the log has come in three parts, refreshed after each."""
    root, log = scratch(s.spark, "maintenance-view"), s.raw("maintenance_log")
    view, parts = maintenance.maintenance_view(s.spark, f"{root}/view"), F.pmod(F.year("event_ts"), F.lit(3))
    for part in range(3):
        log.where(parts == part).write.mode("append").parquet(f"{root}/log")
        view.refresh(f"{root}/log", log.schema, s.raw("station_master"))
    return view.read().withColumn("event_date", F.col("event_date").cast("string"))


@query
def repairs_by_type(s: Site) -> DataFrame:
    return _round(maintenance.repairs_by_type(s.raw("maintenance_log"), s.raw("station_master")), 2,
                  "downtime_min", "parts_cost_usd")


@query
def assign_technician(s: Site) -> DataFrame:
    return maintenance.assign_technician(s.maintenance(), s.raw("technicians")).select(
        "event_id", "station_id", "plant_id", "event_type", "technician_id")


@query
def kpi_maintenance(s: Site) -> DataFrame:
    kpis = MAINTENANCE.query(s.maintenance(), list(MAINTENANCE.measures), by=["plant", "station_type"])
    return _round(_round(kpis, 2, "downtime_min", "parts_cost_usd"), 9, "mttr_min", "preventive_share")


@query
def kpi_maintenance_sql(s: Site) -> DataFrame:
    """`kpi_maintenance` asked in SQL, by a table function of the measures."""
    return s.spark.sql(f"""
        SELECT plant, station_type, failures, corrective_repairs, preventive_repairs, round(downtime_min, 2) AS downtime_min,
               round(parts_cost_usd, 2) AS parts_cost_usd, round(mttr_min, 9) AS mttr_min,
               round(preventive_share, 9) AS preventive_share, stations_with_failures
        FROM {MAINTENANCE.register(s.maintenance())}(array('plant', 'station_type'))""")


@query
def kpi_maintenance_hourly(s: Site) -> DataFrame:
    kpis = MAINTENANCE.query(
        s.maintenance(), ["failures", "downtime_min", "stations_with_failures"],
        by=["event_date", "event_hour", "failure_mode", "criticality"])
    return _round(kpis, 2, "downtime_min").withColumn("event_date", F.col("event_date").cast("string"))


@query
def q_mttr_by_type(s: Site) -> DataFrame:
    return _round(MAINTENANCE.query(s.maintenance(), ["failures", "mttr_min"], by=["station_type"]), 9, "mttr_min")


@query
def q_mttr_by_plant(s: Site) -> DataFrame:
    return _round(MAINTENANCE.query(s.maintenance(), ["mttr_min"], by=["plant"]), 9, "mttr_min")


@query
def q_type_most_failures(s: Site) -> DataFrame:
    per_type = MAINTENANCE.query(s.maintenance(), ["failures"], by=["station_type"])
    return per_type.orderBy(F.col("failures").desc(), "station_type").limit(1)


@query
def q_mode_most_downtime(s: Site) -> DataFrame:
    per_mode = MAINTENANCE.query(
        s.maintenance(), ["downtime_min"], by=["failure_mode"], where=F.col("failure_mode").isNotNull())
    return _round(per_mode.orderBy(F.col("downtime_min").desc(), "failure_mode").limit(1), 2, "downtime_min")


@query
def q_cost_by_plant(s: Site) -> DataFrame:
    return _round(MAINTENANCE.query(s.maintenance(), ["parts_cost_usd"], by=["plant"]), 2, "parts_cost_usd")


@query
def q_preventive_share(s: Site) -> DataFrame:
    return _round(MAINTENANCE.query(s.maintenance(), ["preventive_share"], by=["station_type"]), 9, "preventive_share")


@query
def q_failures_plant(s: Site) -> DataFrame:
    return MAINTENANCE.query(s.maintenance(), ["failures"], where=F.col("plant") == PLANT)


# -- delivery exposure -------------------------------------------------------------------------------------------

def _exposure(s: Site) -> DataFrame:
    return s.exposure()


@query
def dim_line_programs(s: Site) -> DataFrame:
    """Contract terms with the downtime that fell on each line."""
    per_line = s.maintenance().groupBy("line_id").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("downtime_min"), 2).alias("downtime_min"))
    return s.raw("line_programs").join(per_line, "line_id")


@query
def dim_process_steps(s: Site) -> DataFrame:
    """Process steps with the repairs at their positions."""
    stations = s.raw("station_master").select("station_id", F.col("position").alias("station_position"))
    per_step = s.raw("maintenance_log").join(stations, "station_id").groupBy("station_position").agg(
        F.count_if(F.col("event_type") != "failure").alias("repairs"))
    return s.raw("process_steps").join(per_step, "station_position")


@query
def delivery_exposure(s: Site) -> DataFrame:
    return _exposure(s)


@query
def exposure_ranked(s: Site) -> DataFrame:
    ranked = _exposure(s).orderBy(F.col("risk_weighted_exposure_usd").desc(), "line_id")
    return ranked.select(
        "line_id", "customer", "vehicle_program", "riskiest_station_id", "riskiest_process_step",
        "riskiest_risk_band", F.round(F.col("riskiest_failure_probability") * 100, 1).alias("risk_pct"),
        "jis_buffer_min", "typical_unplanned_downtime_min", "line_stop_min_if_fails", "exposure_usd_if_fails",
        "risk_weighted_exposure_usd")


@query
def exposure_by_customer(s: Site) -> DataFrame:
    return exposure.exposure_by_customer(_exposure(s))


@query
def contract_exposure(s: Site) -> DataFrame:
    return exposure.contract_exposure(s.maintenance(), s.raw("line_programs"))


@query
def contract_exposure_fleet(s: Site) -> DataFrame:
    return exposure.contract_exposure_fleet(s.maintenance(), s.raw("line_programs"))


@query
def q_top_exposed_line(s: Site) -> DataFrame:
    ranked = _exposure(s).orderBy(F.col("risk_weighted_exposure_usd").desc(), "line_id")
    return ranked.limit(1).select("line_id", "vehicle_program")


@query
def q_buffer_by_line(s: Site) -> DataFrame:
    return _exposure(s).filter(F.col("customer") == CUSTOMER).orderBy("line_id").select("line_id", "jis_buffer_min")


# -- risk KPIs and fleet -----------------------------------------------------------------------------------------

def _risk_facts(s: Site) -> DataFrame:
    return with_station(s.table("risk_scores"), s.raw("station_master"), "plant_name")


@query
def kpi_risk(s: Site) -> DataFrame:
    kpis = RISK.query(_risk_facts(s), list(RISK.measures), by=["plant", "station_type"])
    return _round(kpis, 11, "avg_failure_probability", "avg_sensor_to_score_s")


@query
def kpi_risk_sql(s: Site) -> DataFrame:
    """`kpi_risk` asked in SQL."""
    return s.spark.sql(f"""
        SELECT plant, station_type, round(avg_failure_probability, 11) AS avg_failure_probability, max_failure_probability,
               scored_windows, high_risk_windows, stations_at_high_risk, stations_down, latest_score_time,
               round(avg_sensor_to_score_s, 11) AS avg_sensor_to_score_s
        FROM {RISK.register(_risk_facts(s))}(array('plant', 'station_type'))""")


@query
def kpi_risk_trend(s: Site) -> DataFrame:
    recent = trailing(_risk_facts(s), "window_end", 900)
    return _round(RISK.query(recent, ["avg_failure_probability", "scored_windows"], by=["plant", "score_minute"]), 11,
                  "avg_failure_probability")


@query
def kpi_risk_by_plant_recent(s: Site) -> DataFrame:
    recent = trailing(_risk_facts(s), "window_end", 600)
    kpis = RISK.query(recent, ["stations_at_high_risk", "avg_failure_probability", "avg_sensor_to_score_s",
                               "latest_score_time"], by=["plant"])
    return _round(kpis, 11, "avg_failure_probability", "avg_sensor_to_score_s")


@query
def q_high_risk_list(s: Site) -> DataFrame:
    high = s.table("health_current").filter("risk_band = 'HIGH'")
    return high.orderBy(F.col("failure_probability").desc(), "station_id").select(
        "station_id", "plant_id", "station_type", F.round(F.col("failure_probability") * 100, 1).alias("risk_pct"),
        "top_signal", "top_signal_deviation_pct")


@query
def q_band_counts(s: Site) -> DataFrame:
    band = F.col("risk_band")
    return s.table("health_current").agg(
        F.count_if(band == "HIGH").alias("high_risk_stations"), F.count_if(band == "DOWN").alias("stations_down"))


@query
def q_top5_risk(s: Site) -> DataFrame:
    return s.table("health_current").orderBy(F.col("failure_probability").desc(), "station_id").limit(5).select(
        "station_id", "failure_probability")


@query
def q_line_bands(s: Site) -> DataFrame:
    return s.table("health_current").filter(F.col("line_id") == LINE).orderBy("station_id").select(
        "station_id", "risk_band")


@query
def fleet_by_band(s: Site) -> DataFrame:
    return observability.fleet_by_band(s.table("health_current"))


@query
def extreme_stations(s: Site) -> DataFrame:
    return observability.extreme_stations(s.table("health_current")).select(
        "side", "station_id", "window_end", "risk_band", "failure_probability")


@query
def station_history(s: Site) -> DataFrame:
    return _round(observability.station_history(s.table("risk_scores"), STATION), 6,
                  *[a for a in _AVERAGES if a != "avg_spindle_rpm"])


@query
def station_grid(s: Site) -> DataFrame:
    return _round(work_orders.station_grid(s.table("health_current"), s.work_orders()), 6, "avg_vibration_rms",
                  "avg_bearing_temp_c", "avg_motor_current_a", "avg_hydraulic_pressure_bar")


# -- work orders -------------------------------------------------------------------------------------------------

def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("failure_probability", F.col("failure_probability").cast("double"))


@query
def work_orders_current(s: Site) -> DataFrame:
    return _plain(s.work_orders())


def _order_facts(s: Site) -> DataFrame:
    return with_station(s.work_orders(), s.raw("station_master"), "plant_name", "station_type")


@query
def kpi_work_orders(s: Site) -> DataFrame:
    kpis = WORK_ORDERS.query(_order_facts(s), list(WORK_ORDERS.measures), by=["plant", "priority", "status"])
    exact = F.col("avg_risk_at_creation").cast("double")
    return _round(kpis, 9, "avg_minutes_to_complete").withColumn("avg_risk_at_creation", exact)


@query
def kpi_work_orders_by_cause(s: Site) -> DataFrame:
    kpis = WORK_ORDERS.query(
        _order_facts(s), ["work_orders", "avg_risk_at_creation"],
        by=["station_type", "risk_band_at_creation", "top_signal_at_creation"], where=F.col("created_date").isNotNull())
    return kpis.withColumn("avg_risk_at_creation", F.col("avg_risk_at_creation").cast("double"))


@query
def open_orders_by_plant_sql(s: Site) -> DataFrame:
    """`q_open_orders_by_plant` asked in SQL."""
    return s.spark.sql(f"SELECT plant, open_work_orders FROM {WORK_ORDERS.register(_order_facts(s))}(array('plant'))")


@query
def q_open_orders_by_plant(s: Site) -> DataFrame:
    return WORK_ORDERS.query(_order_facts(s), ["open_work_orders"], by=["plant"])


@query
def open_orders_by_station(s: Site) -> DataFrame:
    return work_orders.open_orders_by_station(s.work_orders())


@query
def recent_work_orders(s: Site) -> DataFrame:
    return _plain(work_orders.recent_work_orders(s.work_orders(), 50))


@query
def create_work_orders(s: Site) -> DataFrame:
    accepted, _ = work_orders.create_work_orders(s.raw("work_order_requests"), s.table("health_current"))
    return _plain(accepted)


@query
def reject_work_orders(s: Site) -> DataFrame:
    return work_orders.create_work_orders(s.raw("work_order_requests"), s.table("health_current"))[1]


@query
def complete_work_orders(s: Site) -> DataFrame:
    closed, _ = work_orders.complete_work_orders(s.raw("completions"), s.work_orders())
    return _plain(closed)


@query
def repair_commands(s: Site) -> DataFrame:
    return work_orders.complete_work_orders(s.raw("completions"), s.work_orders())[1]


@query
def command_history(s: Site) -> DataFrame:
    return work_orders.command_history(s.raw("commands"), STATION)


@query
def work_order_audit(s: Site) -> DataFrame:
    """Every change in log order."""
    return _plain(s.raw("work_order_changes").orderBy("lsn", "change_type").select(
        "change_type", "lsn", "changed_at", "work_order_id", "station_id", "status", "priority",
        "failure_probability"))


@query
def command_latency(s: Site) -> DataFrame:
    return work_orders.command_latency(s.raw("commands"))


# -- streams -----------------------------------------------------------------------------------------------------

@query
def silver_stream(s: Site) -> DataFrame:
    names = [f"{x}_n" for x in SENSORS]
    return _round(replay.silver(s).select("event_id", "ts", "seq", *STATION_KEYS, *names), 6, *names)


@query
def risk_scores_stream(s: Site) -> DataFrame:
    rows = replay.scores(s).drop("features_at", "scored_at", "model_uri")
    return _round(rows, 6, *FEATURES, *_AVERAGES)


@query
def health_current_stream(s: Site) -> DataFrame:
    return replay.health(s).select(
        *STATION_KEYS, "window_end", "n_readings", "failure_probability", "risk_band", "top_signal")


@query
def health_changes_stream(s: Site) -> DataFrame:
    """Current and fresh stations, out of the changes that keyed state emits."""
    return replay.health_changes(s).select(
        *STATION_KEYS, "window_end", "n_readings", "failure_probability", "risk_band", "top_signal")


@query
def work_orders_stream(s: Site) -> DataFrame:
    return _plain(replay.work_orders(s))


@query
def keyed_serving_stream(s: Site) -> DataFrame:
    return replay.keyed_serving(s).select("station_id", "window_end", "failure_probability", "risk_band")


@query
def sink_commits(s: Site) -> DataFrame:
    """Rows per stream, by the log of its sink."""
    return replay.commits(s).groupBy("writer").agg(F.sum("rows").alias("rows_written"))


@query
def serving_snapshot(s: Site) -> DataFrame:
    return replay.serving(s).select("station_id", "window_end", "failure_probability", "risk_band")


@query
def late_data_audit(s: Site) -> DataFrame:
    return replay.late_data(s)


@query
def stream_progress(s: Site) -> DataFrame:
    return observability.dq_rollup(replay.progress(s))


@query
def stream_flow_rollup(s: Site) -> DataFrame:
    return observability.rows_written(replay.progress(s))


@query
def dq_rollup_stream(s: Site) -> DataFrame:
    """`dq_rollup` kept up to date by a stream of JSON lines, a part of which are cut short."""
    return replay.event_rollup(s)


# -- training and evaluation -------------------------------------------------------------------------------------

@query
def history_summary(s: Site) -> DataFrame:
    return training.history_summary(s.raw("history_readings"))


@query
def training_features(s: Site) -> DataFrame:
    return _round(s.table("training_features"), 6, *FEATURES, *_AVERAGES)


@query
def label_summary(s: Site) -> DataFrame:
    return training.label_summary(s.table("training_features"))


@query
def train_downsample(s: Site) -> DataFrame:
    return training.down_sample(s.table("training_features")).select("station_id", "window_end", "label")


@query
def time_split(s: Site) -> DataFrame:
    train, test = training.time_split(s.table("training_features"))

    def summary(part: DataFrame, name: str) -> DataFrame:
        return part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("windows"),
                        F.sum("label").alias("positive_windows"), F.min("window_end").alias("first_window"),
                        F.max("window_end").alias("last_window"))

    return summary(train, "train").unionByName(summary(test, "test"))


@query
def time_split_sketched(s: Site) -> DataFrame:
    """The cut from hourly sketches, and whether the exact rank of it is within the bound."""
    share, bound = 0.75, sketches.rank_error()
    cut = sketches.split_second(s.table("training_hours"), share)
    span = sketches.rank_span(s.table("training_features"), "window_end", cut)
    near = (F.col("below") <= share + bound) & (F.col("through") >= share - bound)
    return span.select(F.col("rows").alias("windows"), F.lit(share).alias("share"), near.alias("within_bound"))


@query
def risk_episodes(s: Site) -> DataFrame:
    return episodes.risk_episodes(s.scored_training())


@query
def lead_time(s: Site) -> DataFrame:
    return evaluation.lead_time(s.scored_training())


@query
def lead_time_by_mode(s: Site) -> DataFrame:
    return evaluation.lead_time_by_mode(evaluation.lead_time(s.scored_training()))


@query
def lead_time_summary(s: Site) -> DataFrame:
    return evaluation.lead_time_summary(evaluation.lead_time(s.scored_training()))


@query
def model_metrics(s: Site) -> DataFrame:
    metrics = evaluation.model_metrics(s.scored_training())
    return _round(metrics, 9, *[c for c in metrics.columns if c != "windows_at_high"])


@query
def score_spread_sample(s: Site) -> DataFrame:
    return evaluation.score_spread_sample(s.scored_training())


@query
def what_if(s: Site) -> DataFrame:
    scenarios = [(sensor, change) for sensor in SENSORS for change in (-20, -5, 5, 20)]
    return scoring.what_if(s.table("health_current").drop("failure_probability"), scenarios).select(
        "station_id", "sensor", "change_pct", "current_probability", "scenario_probability")


@query
def train_gbt(s: Site) -> DataFrame:
    importances = training.feature_importances(s.model())
    return s.spark.createDataFrame(importances, "feature string, importance double")


@query
def score_gbt(s: Site) -> DataFrame:
    return scoring.by_model(s.model())(s.table("training_features")).select(
        "station_id", "window_end", "label", "failure_probability")


@query
def model_metrics_gbt(s: Site) -> DataFrame:
    """On the held-out later part of the history."""
    _, test = training.time_split(s.table("training_features"))
    return evaluation.model_metrics(scoring.by_model(s.model())(test))


@query
def lead_time_gbt(s: Site) -> DataFrame:
    """Warning times of the fitted model on the held-out part."""
    _, test = training.time_split(s.table("training_features"))
    return evaluation.lead_time(scoring.by_model(s.model())(test))


@query
def score_consistency(s: Site) -> DataFrame:
    """The saved booster on a stream and on the stored readings."""
    return scoring.score_gap(replay.model_scores(s), s.scores(s.table("readings_clean"), scoring.by_model(s.model())))


@query
def grouped_recurrence(s: Site) -> DataFrame:
    return recurrence.vibration_drift(s.raw("history_readings"), block="hour")


# -- observability -----------------------------------------------------------------------------------------------

@query
def layout_skips(s: Site) -> DataFrame:
    """Readings laid out by station and time in 256 files: do filters on one station, and on a hundredth of the time,
    both skip four fifths of them?"""
    path, readings = f"{scratch(s.spark, 'layout')}/readings", s.raw("sensor_readings")
    layout.overwrite_by_curve(readings, path, "station_id", "ts", files=256)
    spans = layout.file_spans(s.spark, path, "station_id", "ts").cache()  # one row per file
    low, high = spans.agg(F.min("min_ts"), F.max("max_ts")).first()
    middle, width = low + (high - low) / 2, (high - low) / 100
    skips = {
        "station_skips": layout.share_skipped(spans, "station_id", F.lit(STATION), F.lit(STATION)),
        "time_skips": layout.share_skipped(spans, "ts", F.lit(middle), F.lit(middle + width)),
    }
    return spans.agg(F.sum("rows").alias("rows")).select("rows", *[(skip >= 0.8).alias(name) for name, skip in skips.items()])


@query
def throughput(s: Site) -> DataFrame:
    return observability.throughput(s.raw("sensor_readings"))


@query
def gateway_throughput(s: Site) -> DataFrame:
    return observability.gateway_throughput(s.raw("sensor_readings"))


@query
def readings_per_minute(s: Site) -> DataFrame:
    return observability.readings_per_minute(s.raw("sensor_readings"))


@query
def duplicate_audit(s: Site) -> DataFrame:
    return observability.duplicate_audit(s.raw("sensor_readings"), s.table("readings_clean"))


@query
def nominal_deviation(s: Site) -> DataFrame:
    return observability.nominal_deviation(s.raw("sensor_readings"), s.raw("station_master"))


@query
def latency_hops(s: Site) -> DataFrame:
    return observability.latency_hops(s.table("readings_clean"), s.table("risk_scores"))


@query
def table_freshness(s: Site) -> DataFrame:
    return observability.table_freshness({
        "sensor_readings": (s.raw("sensor_readings"), "ts", True),
        "readings_clean": (s.table("readings_clean"), "ts", True),
        "risk_scores": (s.table("risk_scores"), "window_end", True),
        "health_current": (s.table("health_current"), "window_end", True),
        "maintenance_events": (s.maintenance(), "event_ts", False),
    })


@query
def fault_timeline(s: Site) -> DataFrame:
    return observability.fault_timeline(s.table("risk_scores"), STATION, INJECTED_AT)


@query
def fault_summary(s: Site) -> DataFrame:
    return observability.fault_summary(s.table("risk_scores"), INJECTED_AT)


@query
def fault_recovery(s: Site) -> DataFrame:
    return observability.fault_recovery(s.table("risk_scores"), INJECTED_AT, REPAIRED_AT)


@query
def dq_rollup(s: Site) -> DataFrame:
    return observability.dq_rollup(s.raw("event_log"))


@query
def dq_rollup_by_dataset(s: Site) -> DataFrame:
    return observability.dq_rollup_by_dataset(s.raw("event_log"))


@query
def flow_rollup(s: Site) -> DataFrame:
    return observability.flow_rollup(s.raw("event_log"), seconds=DAY)


@query
def flow_latest_status(s: Site) -> DataFrame:
    return observability.flow_latest_status(s.raw("event_log"))


@query
def update_history(s: Site) -> DataFrame:
    return observability.update_history(s.raw("event_log"))


@query
def commit_cadence(s: Site) -> DataFrame:
    return observability.commit_cadence(s.raw("commit_log"), seconds=DAY)


@query
def commit_writers(s: Site) -> DataFrame:
    return observability.commit_writers(s.raw("commit_log"))


@query
def lineage_rollup(s: Site) -> DataFrame:
    return observability.lineage_rollup(s.raw("lineage_edges"))


@query
def lineage_by_schema(s: Site) -> DataFrame:
    """Edges that touch one of two schemas."""
    return observability.lineage_rollup(s.raw("lineage_edges"), ("core.", "ml."))


@query
def lineage_into_tables(s: Site) -> DataFrame:
    return observability.lineage_like(s.raw("lineage_edges"), "%.table\\_1%")


@query
def usage_by_requester(s: Site) -> DataFrame:
    return observability.usage_by_requester(s.raw("usage_log"), s.raw("served_entities"), "station-risk")


@query
def result_diff(s: Site) -> DataFrame:
    """Two ways to the same KPI, and a third that leaves out the plain readings."""
    kpi = MAINTENANCE.query(s.maintenance(), ["failures", "mttr_min"], by=["station"])
    typed = s.maintenance().withColumn("repair", F.when(F.col("event_type") == "corrective_repair", F.col("downtime_min")))
    same = typed.groupBy(F.col("station_id").alias("station")).agg(
        F.count_if(F.col("event_type") == "failure").alias("failures"), F.avg("repair").alias("mttr_min"))
    other = same.filter("failures % 2 = 0")
    return compare.result_diff(same, kpi).withColumn("pair", F.lit("same")).unionByName(
        compare.result_diff(other, kpi).withColumn("pair", F.lit("other")))


# -- access ------------------------------------------------------------------------------------------------------

SEES_ALL, SEES_PERSONAL = ("owners", "all_plants"), ("owners", "supervisors")


@query
def column_mask(s: Site) -> DataFrame:
    """Every technician as a supervisor and as a stranger sees the columns."""
    asked = s.raw("technicians").withColumn("seen_by", F.explode(F.array(F.lit("user-5"), F.lit("user-7"))))
    return security.masked_for(asked, ["email", "phone"], s.raw("group_members"), SEES_PERSONAL)


@query
def row_filter(s: Site) -> DataFrame:
    """Every technician for every principal who may see them: by a grant, or as a member of a group that sees all."""
    technicians, members = s.raw("technicians"), s.raw("group_members")
    plants = technicians.select(F.col("home_plant_id").alias("plant_id")).distinct()
    entitled = security.entitlements(plants, s.raw("plant_access"), members, SEES_ALL)
    seen = security.visible_rows(technicians, entitled, "home_plant_id")
    return security.masked_for(seen, ["email", "phone"], members, SEES_PERSONAL)


@query
def secured_read_sql(s: Site) -> DataFrame:
    """`row_filter` asked in SQL: the secured read of every principal, by a table function with the principal as argument."""
    technicians, members = s.raw("technicians"), s.raw("group_members")
    plants = technicians.select(F.col("home_plant_id").alias("plant_id")).distinct()
    entitled = security.entitlements(plants, s.raw("plant_access"), members, SEES_ALL)
    security.register_secured_read(technicians, "technicians", "home_plant_id", ["email", "phone"], entitled,
                                   members.where(F.col("member_of").isin(*SEES_PERSONAL)))
    return s.spark.sql("""
        SELECT seen.*, who.principal AS seen_by FROM (SELECT DISTINCT principal FROM technicians_entitled) who,
        LATERAL technicians_for(who.principal) seen""")


@query
def plants_per_principal(s: Site) -> DataFrame:
    return security.grants_per_principal(s.raw("plant_access"))


# -- value -------------------------------------------------------------------------------------------------------

@query
def scorecard_kpis(s: Site) -> DataFrame:
    return value.scorecard_kpis(s.maintenance())


@query
def value_model(s: Site) -> DataFrame:
    return value.value_model(s.maintenance(), s.raw("line_programs"), s.raw("station_master"))


@query
def value_sensitivity(s: Site) -> DataFrame:
    return value.value_sensitivity(s.maintenance(), s.raw("line_programs"), s.raw("station_master"))


@query
def escape_sensitivity(s: Site) -> DataFrame:
    return value.escape_sensitivity(s.maintenance(), s.raw("line_programs"), s.raw("station_master"))
