from decimal import Decimal

from pyspark.sql import functions as F

from builders import at, rows
from wearline.operators.state import current_from_changes, latest_per_key
from wearline.plans import work_orders
from wearline.schemas import WORK_ORDER_CHANGES


def _changes(spark, *entries):
    data = [
        (kind, lsn, at(lsn), key, "P1-A01", "P1", "P1-A", "P1", status, Decimal("0.5"), "HIGH", "x", "d", None, "u",
         at(0), at(lsn), None)
        for kind, lsn, key, status in entries
    ]
    return spark.createDataFrame(data, WORK_ORDER_CHANGES)


def test_change_log_to_current_state(spark):
    changes = _changes(
        spark, ("insert", 1, 1, "open"), ("update_preimage", 2, 1, "open"), ("update_postimage", 2, 1, "completed"),
        ("insert", 3, 2, "open"), ("delete", 4, 2, "open"),
        ("insert", 5, 3, "open"), ("delete", 6, 3, "open"), ("insert", 7, 3, "in_progress"),
        ("update_preimage", 9, 4, "open"))
    live = current_from_changes(changes, "work_order_id")
    assert rows(live, "work_order_id", "status") == [(1, "completed"), (3, "in_progress")]


def test_latest_per_key_breaks_ties_by_the_second_order_column(spark):
    df = spark.createDataFrame(
        [("A", at(10), at(11), 1), ("A", at(10), at(12), 2), ("A", at(5), at(99), 3), ("B", at(1), at(1), 4)],
        "station_id string, window_end timestamp, scored_at timestamp, n int")
    assert rows(latest_per_key(df, ["station_id"], "window_end", "scored_at"), "station_id", "n") == [("A", 2), ("B", 4)]


def _health(spark):
    return spark.createDataFrame([("P1-A01", "P1", "P1-A", 0.8, "HIGH", "vibration_rms")],
                                 "station_id string, plant_id string, line_id string, failure_probability double, "
                                 "risk_band string, top_signal string")


def test_create_orders(spark):
    requests = spark.createDataFrame(
        [(1, "P1-A01", "P1", "", "u", at(1)), (2, "P1-A01", "P2", None, "u", at(1)), (3, "P1-A01", "P3", "mine", "u", at(1)),
         (4, "P9-Z09", "P1", "", "u", at(1)), (5, "P1-A01", "P9", "", "u", at(1)), (6, "P1-A01", None, "", "u", at(1))],
        "request_id long, station_id string, priority string, description string, created_by string, requested_at timestamp")
    accepted, rejected = work_orders.create_work_orders(requests, _health(spark))
    assert rows(accepted, "work_order_id", "description", "status") == [
        (1, "Predicted vibration_rms issue", "open"), (2, "Predicted vibration_rms issue", "open"), (3, "mine", "open"),
        (6, "Predicted vibration_rms issue", "open")]  # without a priority: the default one
    assert accepted.first().failure_probability == Decimal("0.8000")
    assert rows(rejected, "request_id", "reason") == [(4, "unknown station"), (5, "invalid request")]


def test_complete_orders_emits_one_repair_each(spark):
    orders = work_orders.work_orders_current(_changes(spark, ("insert", 1, 1, "open"), ("insert", 2, 2, "open")))
    done = spark.createDataFrame([(1, at(50), "bo"), (77, at(50), "bo")],
                                 "work_order_id long, completed_at timestamp, completed_by string")
    closed, commands = work_orders.complete_work_orders(done, orders)
    assert rows(closed, "work_order_id", "status", "completed_at") == [(1, "completed", at(50))]
    assert rows(commands, "command", "station_id", "requested_by") == [("repair", "P1-A01", "bo")]


def test_grid_shows_zero_for_stations_without_orders(spark, site):
    health = site.table("health_current")
    grid = work_orders.station_grid(health, site.work_orders().limit(0))
    assert grid.count() == health.count()
    assert grid.agg(F.max("open_work_orders"), F.count_distinct("data_age_s")).first() == (0, 1)


def test_silent_stations_are_not_current(spark):
    from wearline.plans.site import Site
    scores = spark.createDataFrame([("A", at(0), at(1)), ("A", at(1000), at(1001)), ("B", at(399), at(401)), ("C", at(401), at(402))],
                                   "station_id string, window_end timestamp, scored_at timestamp")
    site = Site(spark, "hand-made")
    assert rows(site.health(scores), "station_id", "window_end") == [("A", at(1000)), ("C", at(401))]
    assert rows(site.health(scores, as_of=at(1500)), "station_id") == [("A",)]


def test_request_without_priority_gets_the_default(spark):
    health = spark.createDataFrame([("A", "P1", "L", 0.5, "HIGH", "vibration_rms")],
                                   "station_id string, plant_id string, line_id string, failure_probability double, "
                                   "risk_band string, top_signal string")
    asked = spark.createDataFrame([(1, "A", None, "", "u", at(1)), (2, "A", "P9", "", "u", at(1)), (3, "Z", None, "", "u", at(1))],
                                  "request_id long, station_id string, priority string, description string, "
                                  "created_by string, requested_at timestamp")
    accepted, rejected = work_orders.create_work_orders(asked, health)
    assert rows(accepted, "work_order_id", "priority") == [(1, "P2")]
    assert rows(rejected, "request_id", "reason") == [(2, "invalid request"), (3, "unknown station")]


def test_age_is_that_of_the_newest_reading_shown(spark):
    health = spark.createDataFrame(
        [("A", at(90), at(80)), ("B", at(100), at(95))], "station_id string, window_end timestamp, last_reading_ts timestamp")
    names = ("plant_id", "line_id", "station_type", "criticality", "failure_probability", "risk_band", "top_signal",
             "top_signal_deviation_pct", "avg_vibration_rms", "avg_bearing_temp_c", "avg_motor_current_a",
             "avg_hydraulic_pressure_bar")
    health = health.withColumns({c: F.lit(0) for c in names})
    orders = spark.createDataFrame([], "station_id string, status string")
    assert rows(work_orders.station_grid(health, orders), "station_id", "data_age_s") == [("A", 5.0), ("B", 5.0)]
    assert rows(work_orders.station_grid(health, orders, as_of=at(110)), "data_age_s") == [(15.0,), (15.0,)]
