"""Questions about the data flow itself: speed, freshness, quality, history."""

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.constants import SENSORS
from wearline.functions.columns import ms_between, text_or
from wearline.operators.clean import Expectations, dedup
from wearline.operators.recent import as_of_column, trailing
from wearline.schemas import EXPECTATION_COUNTS


def throughput(bronze: DataFrame, seconds: int = 600, as_of: datetime | None = None) -> DataFrame:
    return trailing(bronze, "ts", seconds, as_of).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("station_id").alias("stations"),
        F.round(F.count(F.lit(1)) / float(seconds), 1).alias("rows_per_second"), F.max("ts").alias("newest_reading"))


def gateway_throughput(bronze: DataFrame, seconds: int = 600, as_of: datetime | None = None) -> DataFrame:
    now = as_of_column(bronze, "ts", as_of)
    return trailing(bronze, "ts", seconds, as_of).groupBy("gateway_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("station_id").alias("stations"),
        F.round(F.count(F.lit(1)) / float(seconds), 1).alias("rows_per_second"), F.max("ts").alias("newest_reading"),
    ).withColumn("seconds_behind", F.unix_seconds(now) - F.unix_seconds("newest_reading"))


def readings_per_minute(bronze: DataFrame, seconds: int = 600, as_of: datetime | None = None) -> DataFrame:
    return trailing(bronze, "ts", seconds, as_of).groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("station_id").alias("stations"))


def duplicate_audit(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Delivered rows, distinct events, trusted rows."""
    rows = F.count(F.lit(1))
    events = dedup(bronze.select("event_id").where("event_id IS NOT NULL"))
    return bronze.agg(rows.alias("bronze_rows")).withColumns(
        {"distinct_event_ids": events.agg(rows).scalar(), "silver_rows": silver.agg(rows).scalar()})


def nominal_deviation(
    bronze: DataFrame, station_master: DataFrame, n: int = 10, seconds: int = 60, as_of: datetime | None = None
) -> DataFrame:
    """Stations whose latest averages lie farthest from nominal."""
    watched = {"vibration": "vibration_rms", "temp": "bearing_temp_c", "pressure": "hydraulic_pressure_bar"}
    stations = station_master.select("station_id", "station_type", *[f"nom_{s}" for s in watched.values()])
    ratios = trailing(bronze, "ts", seconds, as_of).join(stations, "station_id").groupBy(
        "station_id", "station_type"
    ).agg(
        *[F.avg(F.try_divide(s, f"nom_{s}")).alias(name) for name, s in watched.items()],
        F.avg("spindle_rpm").alias("rpm"))
    farthest = F.greatest(*[F.abs(F.col(name) - 1) for name in watched])
    return ratios.orderBy(farthest.desc(), "station_id").limit(n).select(
        "station_id", "station_type", *[F.round(name, 2).alias(f"{name}_x_nominal") for name in watched],
        F.round("rpm", 0).alias("rpm"))


def latency_hops(
    silver: DataFrame, scores: DataFrame, seconds: int = 600,
    silver_as_of: datetime | None = None, scores_as_of: datetime | None = None,
) -> DataFrame:
    """Exact p50 and p95 per hop. Equal latencies (whole milliseconds) are counted first, so the final aggregate
    sees distinct values only; the three hops of a score come from one scan."""
    hops = {
        "sensor_to_features": ("last_reading_ts", "features_at"),
        "features_to_score": ("features_at", "scored_at"),
        "sensor_to_score": ("last_reading_ts", "scored_at"),
    }
    first = trailing(silver, "ts", seconds, silver_as_of).select(
        F.lit("sensor_to_silver").alias("hop"), ms_between("ts", "silver_at").alias("ms"))
    later = trailing(scores, "window_end", seconds, scores_as_of).select(F.inline(F.array(*[
        F.struct(F.lit(hop).alias("hop"), ms_between(start, end).alias("ms")) for hop, (start, end) in hops.items()
    ])))
    counted = first.unionByName(later).groupBy("hop", "ms").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("hop").agg(
        F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95)), F.col("n")).alias("p"), F.sum("n").alias("n")
    ).select("hop", F.round(F.col("p")[0] / 1000, 1).alias("p50_s"), F.round(F.col("p")[1] / 1000, 1).alias("p95_s"),
             "n")


def table_freshness(tables: Mapping[str, tuple[DataFrame, str, bool]], as_of: datetime | None = None) -> DataFrame:
    """Rows and newest event per table, and for live tables the seconds behind the newest event of any of them.

    `tables` maps a name to (table, event time column, is it live).
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.max(column).alias("newest")).select(
            F.lit(name).alias("table_name"), "rows", "newest", F.lit(live).alias("live"))
        for name, (df, column, live) in tables.items()
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    if as_of is None:  # one row per table: the newest of them is found without reading the tables again
        every = every.withColumn("now", F.expr("max(CASE WHEN live THEN newest END) OVER ()"))
    else:
        every = every.withColumn("now", F.lit(as_of))
    behind = F.when(F.col("live"), F.unix_seconds("now") - F.unix_seconds("newest"))
    return every.select("table_name", "rows", "newest", behind.alias("seconds_behind"))


# -- event log ---------------------------------------------------------------------------------------------------

_DETAILS = T.StructType([
    T.StructField("create_update", T.StructType([T.StructField("cause", T.StringType())])),
    T.StructField("update_progress", T.StructType([T.StructField("state", T.StringType())])),
    T.StructField("flow_progress", T.StructType([
        T.StructField("status", T.StringType()),
        T.StructField("metrics", T.StructType([T.StructField("num_output_rows", T.LongType())])),
        T.StructField("data_quality", T.StructType([T.StructField("expectations", EXPECTATION_COUNTS)])),
    ])),
])


def parsed_event_log(log: DataFrame) -> DataFrame:
    """The JSON details as a struct; fields a query does not use are pruned from the parse."""
    return log.withColumn("d", F.from_json("details", _DETAILS))


def dq_rollup(log: DataFrame) -> DataFrame:
    """Passed and failed rows per flow and rule over the whole log."""
    checks = parsed_event_log(log.filter("event_type = 'flow_progress'")).select(
        "flow_name", F.inline("d.flow_progress.data_quality.expectations"))
    return checks.groupBy("flow_name", F.col("name").alias("expectation")).agg(
        F.sum("passed_records").alias("passed"), F.sum("failed_records").alias("failed"))


def rows_written(log: DataFrame) -> DataFrame:
    """Rows each flow has written over the whole log."""
    flows = parsed_event_log(log.filter("event_type = 'flow_progress'")).groupBy(F.col("flow_name").alias("flow"))
    return flows.agg(F.sum("d.flow_progress.metrics.num_output_rows").alias("output_rows"))


def dq_rollup_by_dataset(log: DataFrame) -> DataFrame:
    """The same by the last part of the flow's three-part name."""
    totals = dq_rollup(log).withColumn("dataset", F.get(F.split("flow_name", "\\."), F.lit(2)))
    return totals.groupBy("dataset", "expectation").agg(
        F.sum("passed").alias("passed"), F.sum("failed").alias("failed_or_dropped"))


def flow_rollup(log: DataFrame, seconds: int = 600, as_of: datetime | None = None) -> DataFrame:
    rows = parsed_event_log(trailing(log, "timestamp", seconds, as_of).filter("event_type = 'flow_progress'"))
    output = F.col("d.flow_progress.metrics.num_output_rows")
    return rows.filter(output.isNotNull()).groupBy(F.col("flow_name").alias("flow")).agg(
        F.count(F.lit(1)).alias("micro_batches"), F.sum(output).alias("output_rows"))


def update_history(log: DataFrame, n: int = 8) -> DataFrame:
    """The latest updates with their cause and last state."""
    state, cause = F.col("d.update_progress.state"), F.col("d.create_update.cause")
    return (
        parsed_event_log(log).groupBy("update_id")
        .agg(F.min("timestamp").alias("started"), F.max("timestamp").alias("last_event"),
             F.max_by(state, F.when(F.col("event_type") == "update_progress", F.col("timestamp"))).alias("last_state"),
             F.min_by(cause, F.when(cause.isNotNull(), F.col("timestamp"))).alias("cause"))
        .orderBy(F.col("started").desc(), "update_id").limit(n)
    )


def flow_latest_status(log: DataFrame) -> DataFrame:
    """Latest status per flow within the newest update."""
    newest = log.agg(F.max_by("update_id", "timestamp")).scalar()
    status = F.col("d.flow_progress.status")
    rows = parsed_event_log(log.filter((F.col("event_type") == "flow_progress") & (F.col("update_id") == newest)))
    return rows.filter(status.isNotNull()).groupBy(F.col("flow_name").alias("flow")).agg(
        F.max_by(status, "timestamp").alias("latest_status"), F.max("timestamp").alias("at"))


# -- commits, lineage, usage -------------------------------------------------------------------------------------

def commit_cadence(commits: DataFrame, seconds: int = 600, as_of: datetime | None = None) -> DataFrame:
    """Commits per writer in the trailing time and the mean gap between each and the one before.

    The first one's gap reaches back to the last commit ahead of the trailing time, if there is one. Consecutive gaps add
    up to last minus first, so their mean needs neither an order nor a window over a writer's whole log.
    """
    second = F.unix_seconds("ts")
    recent = F.col("ts") > as_of_column(commits, "ts", as_of) - F.expr(f"INTERVAL {seconds} SECOND")
    spans = commits.groupBy("writer").agg(
        F.count_if(recent).alias("commits"), F.max(second).alias("_last"), F.min(F.when(recent, second)).alias("_first"),
        F.max(F.when(~recent, second)).alias("_ahead")).where("commits > 0")
    gaps = F.when(F.col("_ahead").isNull(), F.col("commits") - 1).otherwise(F.col("commits"))
    mean = F.try_divide(F.col("_last") - F.coalesce("_ahead", "_first"), gaps)
    return spans.select("writer", "commits", F.round(mean, 1).alias("avg_gap_s"))


def commit_writers(commits: DataFrame) -> DataFrame:
    return commits.groupBy(text_or("user_name", F.lit("(not recorded)")).alias("user_name"), "writer", "operation").agg(
        F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"))


def lineage_rollup(edges: DataFrame, schemas: tuple[str, ...] = ("",)) -> DataFrame:
    """Edges that start or end in one of the schemas (name prefixes; all by default)."""
    def inside(column: str) -> Column:
        hit = F.lit(False)
        for schema in schemas:
            hit = hit | F.col(column).startswith(schema)
        return hit

    return _edges_seen(edges.filter(inside("source_table") | inside("target_table")))


def lineage_like(edges: DataFrame, pattern: str) -> DataFrame:
    """Edges into tables whose whole name matches a LIKE pattern."""
    return _edges_seen(edges.filter(F.col("target_table").like(pattern)))


def _edges_seen(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_table", "target_table", "entity_type").agg(
        F.max("event_time").alias("last_seen"), F.count(F.lit(1)).alias("events"))


def usage_by_requester(usage: DataFrame, served: DataFrame, endpoint: str) -> DataFrame:
    entities = served.filter(F.col("endpoint_name") == endpoint).select("served_entity_id")
    return usage.join(entities, "served_entity_id").groupBy("requester", "status_code").agg(
        F.count(F.lit(1)).alias("requests"), F.min("request_time").alias("first_request"),
        F.max("request_time").alias("last_request"))


# -- faults ------------------------------------------------------------------------------------------------------

def fault_timeline(scores: DataFrame, station_id: str, injected_at: datetime, every_s: int = 30, n: int = 40) -> DataFrame:
    """Risk of one station from a minute before the fault on, thinned to every 30 seconds."""
    rows = scores.filter(
        (F.col("station_id") == station_id)
        & (F.col("window_end") >= F.lit(injected_at) - F.expr("INTERVAL 1 MINUTE"))
        & (F.second("window_end") % every_s == 0))
    return rows.orderBy("window_end").limit(n).select(
        "window_end", F.round(F.col("failure_probability") * 100, 1).alias("risk_pct"), "risk_band", "top_signal",
        "top_signal_deviation_pct", F.round("avg_vibration_rms", 2).alias("vibration"),
        F.round("avg_bearing_temp_c", 1).alias("temp_c"), F.round("avg_hydraulic_pressure_bar", 1).alias("pressure"),
        F.round("avg_motor_current_a", 1).alias("current_a"))


def _first_end(*bands: str) -> Column:
    return F.min(F.when(F.col("risk_band").isin(*bands), F.col("window_end")))


def fault_summary(scores: DataFrame, injected_at: datetime) -> DataFrame:
    """Per station with scores since the fault: when risk rose, when it stopped, and the warning in between."""
    high, down = _first_end("HIGH"), _first_end("DOWN")
    return scores.filter(F.col("window_end") >= F.lit(injected_at)).groupBy("station_id").agg(
        _first_end("ELEVATED", "HIGH").alias("first_elevated"), high.alias("first_high"), down.alias("station_down"),
        (F.unix_seconds(down) - F.unix_seconds(high)).alias("warning_before_failure_s"))


def fault_recovery(scores: DataFrame, injected_at: datetime, repaired_at: datetime, below: float = 0.2) -> DataFrame:
    """Per station: first calm window after the repair, and whether it never stopped since the fault."""
    calm = (F.col("risk_band") == "NORMAL") & (F.col("failure_probability") < below) & (
        F.col("window_end") > F.lit(repaired_at))
    recovered = F.min(F.when(calm, F.col("window_end")))
    return scores.filter(F.col("window_end") >= F.lit(injected_at)).groupBy("station_id").agg(
        recovered.alias("recovered_at"),
        (F.unix_seconds(recovered) - F.unix_seconds(F.lit(repaired_at))).alias("seconds_to_recover"),
        F.count_if(F.col("risk_band") == "DOWN").alias("down_windows"),
    ).withColumn("prevented", F.col("recovered_at").isNotNull() & (F.col("down_windows") == 0))


# -- fleet -------------------------------------------------------------------------------------------------------

def fleet_by_band(health: DataFrame) -> DataFrame:
    return health.groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("stations"), F.round(F.avg("failure_probability") * 100, 1).alias("avg_risk_pct"),
        F.max("window_end").alias("latest_window"))


def station_history(scores: DataFrame, station_id: str, seconds: int = 900, as_of: datetime | None = None) -> DataFrame:
    return trailing(scores, "window_end", seconds, as_of).filter(F.col("station_id") == station_id).orderBy(
        "window_end"
    ).select("window_end", "failure_probability", "risk_band", "top_signal", *[
        f"avg_{s}" for s in SENSORS if s != "spindle_rpm"])


def extreme_stations(health: DataFrame, n: int = 6) -> DataFrame:
    """The `n` riskiest and the `n` calmest stations; a small fleet may show a station twice."""
    riskiest = health.orderBy(F.col("failure_probability").desc(), "station_id").limit(n)
    calmest = health.orderBy("failure_probability", "station_id").limit(n)
    return riskiest.withColumn("side", F.lit("riskiest")).unionByName(calmest.withColumn("side", F.lit("calmest")))


def rule_counts(tables: Mapping[str, tuple[DataFrame, Expectations]]) -> DataFrame:
    """(dataset, expectation, passed, failed) for several tables."""
    parts = [rules.summary(df, name) for name, (df, rules) in tables.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every
