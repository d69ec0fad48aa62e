from pyspark.sql import functions as F

from builders import at, reading, readings, rows, station_master
from wearline.operators.clean import (
    COMMAND_DOMAIN, VALID_READING, WORK_ORDER_DOMAIN, Expectations, clean, dedup, normalize, not_from_future,
)


def test_dedup_keeps_one_row_per_event(spark):
    df = readings(spark, [reading("A", 1), reading("A", 1), reading("A", 2)])
    assert dedup(df).count() == 2


def test_dedup_sends_hashes_and_repeated_rows_only(spark):
    """Any keys, null and repeated ones; rows of keys that occur once are not shuffled."""
    data = [reading("A", s, f"e{s}") for s in range(500)] + [reading("A", s, f"e{s}") for s in range(0, 500, 50)] * 3
    df = readings(spark, data).withColumn("event_id", F.when(F.col("seq") % 100 != 7, F.col("event_id")))
    once = dedup(df)
    assert rows(once, "event_id") == rows(df.select("event_id").distinct(), "event_id")
    assert once.columns == df.columns
    by_both = dedup(df, ["event_id", "seq"])
    assert rows(by_both, "event_id", "seq") == rows(df.select("event_id", "seq").distinct(), "event_id", "seq")
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_key" in plan and "Union" in plan
    assert dedup(df.limit(0)).count() == 0


def test_dedup_comes_before_the_rules(spark):
    """Whichever copy is kept decides: two bad copies leave nothing, and no event is ever seen twice."""
    master = station_master(spark, ("A", "P1", "P1-A", "press"))
    df = readings(spark, [
        reading("A", 1, "x", vibration_rms=99.0), reading("A", 1, "x", vibration_rms=99.0), reading("A", 2, "y"),
        reading("A", 2, "y")])
    assert rows(clean(df, master), "event_id") == [("y",)]


def test_unknown_and_missing_stations_disappear_in_the_join(spark):
    master = station_master(spark, ("A", "P1", "P1-A", "press"))
    df = readings(spark, [reading("A", 1), reading("Z", 1), reading(None, 1, "n")])
    scaled = normalize(df, master)
    assert rows(scaled, "station_id", "plant_id", "line_id") == [("A", "P1", "P1-A")]
    assert VALID_READING.summary(scaled, "x").filter("expectation = 'valid_station'").first().failed == 0


def test_zero_nominal_gives_null_not_an_error(spark):
    master = station_master(spark, ("A", "P1", "P1-A", "press", 0.0))
    assert normalize(readings(spark, [reading("A", 1)]), master).first().vibration_rms_n is None


def test_null_fails_a_rule_and_sensors_without_a_rule_are_free(spark):
    master = station_master(spark, ("A", "P1", "P1-A", "press"))
    df = readings(spark, [
        reading("A", 1, bearing_temp_c=None), reading("A", 2, spindle_rpm=-5.0), reading("A", None, "no-time"),
        reading("A", 3, bearing_temp_c=250.0), reading("A", 4, bearing_temp_c=250.1)])
    kept = clean(df, master)
    assert rows(kept, "event_id") == [("A-2",), ("A-3",)]
    counts = {r.expectation: (r.passed, r.failed) for r in VALID_READING.summary(normalize(df, master), "r").collect()}
    assert counts["temperature_in_range"] == (3, 2)
    assert counts["valid_ts"] == (4, 1)
    assert counts["vibration_in_range"] == (5, 0)


def test_warning_keeps_rows_and_counts_them(spark):
    df = readings(spark, [reading("A", 0), reading("A", 60), reading("A", 61), reading("A", None, "n")])
    rule = not_from_future("TIMESTAMP '2024-01-01 00:00:00'")
    result = rule.summary(df, "r").first()
    assert (result.passed, result.failed) == (2, 2)


def test_domains(spark):
    orders = spark.createDataFrame([("P1", "open"), ("P9", "open"), ("P2", "lost"), (None, "open")],
                                   "priority string, status string")
    assert WORK_ORDER_DOMAIN.drop(orders).count() == 1
    commands = spark.createDataFrame([("repair", "pending"), ("explode", "applied")], "command string, status string")
    assert COMMAND_DOMAIN.drop(commands).count() == 1


def test_rules_reach_the_parquet_scan(spark, tmp_path):
    spark.range(10).withColumn("v", F.col("id") * 1.5).write.parquet(str(tmp_path / "t"))
    plan = Expectations({"r": "v BETWEEN 2 AND 4"}).drop(spark.read.parquet(str(tmp_path / "t")))
    assert "GreaterThanOrEqual(v" in plan._jdf.queryExecution().toString()


def test_builders_clock():
    assert at(61).minute == 1


def test_stored_silver_is_scaled_where_it_is_read(spark, site):
    stored, plan = site.table("readings_clean"), site.silver()
    assert stored.dtypes == plan.dtypes
    assert stored.exceptAll(plan).isEmpty() and plan.exceptAll(stored).isEmpty()
    files = spark.read.parquet(site._built["readings_clean"])
    assert not [c for c in files.columns if c.endswith("_n")]
