import pytest
from pyspark.sql import functions as F

from builders import at, rows
from wearline.operators import compare, security
from wearline.operators.metrics import MAINTENANCE, RISK, with_station
from wearline.plans import exposure, maintenance, observability, value

EVENTS = ("station_id string, plant_id string, plant_name string, line_id string, station_type string, criticality string, "
          "event_ts timestamp, event_type string, failure_mode string, downtime_min double, parts_cost_usd double, "
          "source string")


def _events(spark, *entries):
    """(station type, event type, downtime, parts)"""
    data = [("S-01", "P1", "One", "L1", kind, "high", at(i), event, "m", float(dt), float(parts), "history")
            for i, (kind, event, dt, parts) in enumerate(entries)]
    return spark.createDataFrame(data, EVENTS).withColumn("event_date", F.to_date("event_ts"))


def test_maintenance_measures(spark):
    df = _events(spark, ("press", "corrective_repair", 100, 10), ("press", "corrective_repair", 50, 10),
                 ("press", "preventive_repair", 20, 1), ("press", "failure", 0, 0), ("welder", "failure", 0, 0))
    got = {r.station_type: r for r in MAINTENANCE.query(df, list(MAINTENANCE.measures), by=["station_type"]).collect()}
    press = got["press"]
    assert (press.failures, press.corrective_repairs, press.preventive_repairs) == (1, 2, 1)
    assert (press.mttr_min, press.downtime_min, press.stations_with_failures) == (75.0, 170.0, 1)
    assert press.preventive_share == pytest.approx(1 / 3)
    assert got["welder"].preventive_share is None and got["welder"].mttr_min is None
    with pytest.raises(KeyError, match="maintenance has no mood"):
        MAINTENANCE.query(df, ["mood"])


def test_measures_from_sql(spark):
    df = _events(spark, ("press", "corrective_repair", 100, 10), ("press", "corrective_repair", 50, 10),
                 ("press", "preventive_repair", 20, 1), ("press", "failure", 0, 0), ("welder", "failure", 0, 0))
    assert MAINTENANCE.register(df) == "maintenance_by"
    names = list(MAINTENANCE.measures)
    for by in ([], ["station_type"], ["event_type", "plant"], list(MAINTENANCE.dimensions)):
        listed = ", ".join(f"'{d}'" for d in by)
        got = spark.sql(f"SELECT {', '.join(by + names)} FROM maintenance_by(array({listed}))")
        assert rows(got, *by, *names) == rows(MAINTENANCE.query(df, names, by=by), *by, *names)
    one = spark.sql("SELECT station_type, plant, mttr_min FROM maintenance_by(array('station_type')) WHERE failures > 0")
    assert rows(one, "station_type", "plant", "mttr_min") == [("press", None, 75.0), ("welder", None, None)]
    few = spark.sql("SELECT station_type, failures FROM maintenance_by(array('station_type'))")
    top = few._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert top.startswith("Aggregate") and "count_if" not in top.replace("failures", "") and "sum(" not in top
    assert "distinct" not in top and "avg(" not in top  # measures not asked for are not computed
    with pytest.raises(Exception, match="maintenance has no mood"):
        spark.sql("SELECT failures FROM maintenance_by(array('mood'))").collect()
    MAINTENANCE.register(df.where("false"))
    assert spark.sql("SELECT failures FROM maintenance_by(NULL)").collect() == []


def test_secured_read_from_sql(spark):
    people = spark.createDataFrame([(1, "P1", "a@x"), (2, "P2", None), (3, None, "c@x")], "id int, plant string, email string")
    entitled = spark.createDataFrame([("ann", "P1"), ("ann", "P1"), ("bob", "P1"), ("bob", "P2")],
                                     "principal string, plant_id string")
    trusted = spark.createDataFrame([("bob",), ("bob",), ("eve",)], "principal string")
    security.register_secured_read(people, "people", "plant", ["email"], entitled, trusted)

    def seen(who):
        return rows(spark.sql(f"SELECT * FROM people_for({who})"), "id", "plant", "email")

    assert seen("'ann'") == [(1, "P1", "***redacted***")]
    assert seen("'bob'") == [(1, "P1", "a@x"), (2, "P2", None)]
    assert seen("'eve'") == seen("NULL") == seen("'x'' OR ''1'' = ''1'") == []


def test_star_join_keeps_unknown_stations(spark):
    master = spark.createDataFrame([("A", "One")], "station_id string, plant_name string")
    scores = spark.createDataFrame(
        [("A", "HIGH", 0.8, at(0), at(0), at(1)), ("Z", "DOWN", 0.1, at(0), at(0), at(3))],
        "station_id string, risk_band string, failure_probability double, window_end timestamp, "
        "last_reading_ts timestamp, scored_at timestamp")
    scores = scores.withColumns({c: F.lit("x") for c in ("line_id", "station_type", "criticality", "top_signal")})
    kpis = RISK.query(with_station(scores, master, "plant_name"),
                      ["scored_windows", "stations_down", "avg_sensor_to_score_s"], by=["plant"])
    assert rows(kpis, "plant", "scored_windows", "stations_down", "avg_sensor_to_score_s") == [
        (None, 1, 1, 3.0), ("One", 1, 0, 1.0)]


def _exposure(spark, health, events):
    programs = spark.createDataFrame([("L1", "c", "v", "f", 60, 100, 1), ("L2", "c", "v", "f", 60, 100, 1)],
                                     "line_id string, customer string, vehicle_program string, part_family string, "
                                     "jis_buffer_min int, line_stop_charge_usd_per_min int, units_per_hour int")
    steps = spark.createDataFrame([(1, "other", "step one", "q")], "station_position int, station_type string, "
                                  "process_step string, critical_quality_characteristic string")
    return exposure.delivery_exposure(health, events, programs, steps)


def _health(spark, *entries):
    """(line, station, type, probability, band)"""
    return spark.createDataFrame(
        [(line, "P1", sid, kind, p, band, "x") for line, sid, kind, p, band in entries],
        "line_id string, plant_id string, station_id string, station_type string, failure_probability double, "
        "risk_band string, top_signal string")


def test_exposure_rounds_only_at_the_end_and_breaks_ties(spark):
    health = _health(spark, ("L1", "B-01", "press", 0.5, "ELEVATED"), ("L1", "A-01", "press", 0.5, "HIGH"))
    events = _events(spark, ("press", "corrective_repair", 60.4, 0), ("press", "preventive_repair", 900, 0))
    row = _exposure(spark, health, events).first()
    assert row.riskiest_station_id == "A-01" and row.riskiest_process_step == "step one"
    assert (row.high_risk_stations, row.elevated_risk_stations) == (1, 1)
    assert (row.typical_unplanned_downtime_min, row.line_stop_min_if_fails) == (60.0, 0.0)
    assert (row.exposure_usd_if_fails, row.risk_weighted_exposure_usd) == (40.0, 20.0)


def test_lines_without_risk_or_without_repairs_of_the_type_disappear(spark):
    health = _health(spark, ("L1", "A-01", "welder", 0.5, "HIGH"))
    assert _exposure(spark, health, _events(spark, ("press", "corrective_repair", 90, 0))).count() == 0
    assert rows(_exposure(spark, health, _events(spark, ("welder", "corrective_repair", 90, 0))), "line_id") == [("L1",)]


def test_technicians_are_numbered_densely_and_assigned_repeatably(spark):
    staff = spark.range(5000).select(
        F.concat(F.lit("T"), "id").alias("technician_id"),
        F.when(F.col("id") % 3 == 0, "P2").otherwise("P1").alias("home_plant_id"))
    numbered = maintenance.numbered_within(staff, "home_plant_id", "technician_id")
    per_plant = numbered.groupBy("home_plant_id").agg(
        F.count("*").alias("n"), F.count_distinct("number").alias("d"), F.min("number").alias("lo"),
        F.max("number").alias("hi"), F.max("group_rows").alias("g"))
    for r in per_plant.collect():
        assert r.lo == 1 and r.n == r.d == r.hi == r.g
    events = spark.range(3000).select(
        F.concat(F.lit("E"), "id").alias("event_id"), F.lit(None).cast("string").alias("technician_id"),
        F.when(F.col("id") % 2 == 0, "P1").when(F.col("id") % 3 == 0, "P3").otherwise("P2").alias("plant_id"),
        F.when(F.col("id") % 5 == 0, "failure").otherwise("corrective_repair").alias("event_type"))
    once = maintenance.assign_technician(events, staff)
    again = maintenance.assign_technician(events.repartition(7), staff.repartition(3))
    assert once.count() == 3000 and once.exceptAll(again).isEmpty()
    assert once.filter("(event_type = 'failure' OR plant_id = 'P3') <> (technician_id IS NULL)").isEmpty()
    wrong = once.join(staff, "technician_id").filter("plant_id <> home_plant_id")
    assert wrong.isEmpty()


def test_value_model_by_hand(spark):
    events = _events(spark, ("press", "corrective_repair", 120, 5000), ("press", "preventive_repair", 30, 500))
    programs = spark.createDataFrame([("L1", 60, 100), ("L2", 150, 100)],
                                     "line_id string, jis_buffer_min int, line_stop_charge_usd_per_min int")
    stations = spark.range(10)
    got = {r.metric: r.base_case for r in value.value_model(events, programs, stations).collect()}
    converted = 10 * 2 * 0.7
    assert got["failures"] == 20 and got["converted"] == 14
    assert got["downtime_h_avoided"] == round(converted * 90 / 60, 2)
    false_alarms = converted / 0.95 - converted
    assert got["layer1_net_usd"] == pytest.approx(
        converted * 1.5 * 15000 + converted * 4500 - false_alarms * (500 + 0.5 * 15000), abs=0.01)
    assert got["layer2_usd"] == pytest.approx(20 * 0.05 * 0.7 * 3000, abs=0.01)
    grid = value.value_sensitivity(events, programs, stations).collect()
    assert [r.converted_to_planned for r in grid] == ["50%", "70%", "90%"]
    kpis = {r.kpi: (r.today, r.with_conversion) for r in value.scorecard_kpis(events).collect()}
    assert kpis["unplanned_repairs"] == (1.0, 0.0) and kpis["planned_share_pct"] == (50.0, 100.0)


def test_row_filter_and_masks(spark):
    people = spark.createDataFrame([("T1", "P1", "a@x"), ("T2", "P2", "b@x")],
                                   "technician_id string, home_plant_id string, email string")
    access = spark.createDataFrame([("u", "P1"), ("u", "P1"), ("v", "P2"), ("v", "P1")], "principal string, plant_id string")

    members = spark.createDataFrame([("boss", "owners"), ("lead", "all"), ("v", "supervisors")],
                                    "principal string, member_of string")
    plants = people.select(F.col("home_plant_id").alias("plant_id"))
    entitled = security.entitlements(plants, access, members, ("owners", "all"))
    seen = security.masked_for(security.visible_rows(people, entitled, "home_plant_id"), ["email"], members,
                               ("owners", "supervisors"))
    hidden = "***redacted***"
    assert rows(seen, "seen_by", "technician_id", "email") == [
        ("boss", "T1", "a@x"), ("boss", "T2", "b@x"), ("lead", "T1", hidden), ("lead", "T2", hidden), ("u", "T1", hidden),
        ("v", "T1", "a@x"), ("v", "T2", "b@x")]
    unknown = people.withColumn("who", F.lit(None).cast("boolean"))
    assert rows(security.masked(unknown, ["email"], F.col("who")), "email") == [(hidden,)] * 2
    assert rows(security.grants_per_principal(access), "principal", "plants") == [("u", "P1"), ("v", "P1,P2")]


def test_result_diff_counts_repeated_rows(spark):
    a = spark.createDataFrame([(1, 0.101), (1, 0.101), (2, -0.001), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 0.1), (2, 0.0), (2, 0.0), (3, None)], "k int, v double")
    diff = compare.result_diff(a.withColumn("extra", F.lit(1)), b).first()
    assert (diff.actual_rows, diff.expected_rows, diff.unexpected_rows, diff.missing_rows, diff.same) == (4, 4, 1, 1, False)
    assert compare.result_diff(a, a).first().same


def test_fault_recovery(spark):
    data = [("A", at(60), "HIGH", 0.9), ("A", at(90), "NORMAL", 0.3), ("A", at(120), "NORMAL", 0.1),
            ("B", at(60), "DOWN", 0.9), ("B", at(120), "NORMAL", 0.1), ("C", at(60), "NORMAL", 0.1)]
    scores = spark.createDataFrame(data, "station_id string, window_end timestamp, risk_band string, failure_probability double")
    got = {r.station_id: r for r in observability.fault_recovery(scores, at(30), at(70)).collect()}
    assert got["A"].prevented and got["A"].seconds_to_recover == 50
    assert not got["B"].prevented and got["B"].down_windows == 1
    assert not got["C"].prevented and got["C"].recovered_at is None


def test_as_of_reaches_the_scan(spark, site):
    scores = site.table("risk_scores")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = observability.station_history(scores, "P1-A04", as_of=at(60))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(station_id,P1-A04)" in plan and "GreaterThan(window_end" in plan


def test_views_and_functions_for_sql_users(spark, site):
    names = site.register_views()
    assert {"risk_scores", "health_current", "maintenance_events", "delivery_exposure", "technicians"} <= set(names)
    top = spark.sql("SELECT risk_band, count(*) AS n FROM health_current GROUP BY ALL")
    assert top.agg(F.sum("n")).first()[0] == site.table("health_current").count()
    seen = spark.sql("SELECT DISTINCT home_plant_id, mask_personal(email, false) AS email FROM technicians "
                     "WHERE may_see_plant(home_plant_id, array('P1'), false)").collect()
    assert [tuple(r) for r in seen] == [("P1", "***redacted***")]


def test_workspace_is_under_the_shared_folder(spark):
    from wearline.session import workspace

    class Context:
        applicationId, master = "app-1", "spark://cluster"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        def __init__(self, folder):
            self.conf = {"spark.checkpoint.dir": folder}

    assert workspace(Session("hdfs:///shared/"), "t") == "hdfs:///shared/wearline/app-1/t"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace(Session(None))


def test_converted_repairs_round_half_to_even(spark):
    events = _events(spark, *[("press", "corrective_repair", 60, 100)] * 15, ("press", "preventive_repair", 30, 50))
    kpis = {r.kpi: r.with_conversion for r in value.scorecard_kpis(events).collect()}
    assert kpis["unplanned_repairs"] == 5.0  # 10.5 becomes 10
