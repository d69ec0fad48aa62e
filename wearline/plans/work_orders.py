"""Work orders and commands: creation, completion, audit, backlog."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.constants import STATION_KEYS
from wearline.functions.columns import ms_between, text_or
from wearline.operators.clean import WORK_ORDER_DOMAIN
from wearline.operators.recent import as_of_column
from wearline.operators.state import current_from_changes

LIVE_COLUMNS = (
    "work_order_id", "station_id", "plant_id", "line_id", "priority", "status", "failure_probability", "risk_band",
    "top_signal", "description", "assigned_technician_id", "created_by", "created_at", "updated_at", "completed_at",
)
_OPEN = ("open", "in_progress")


def work_orders_current(changes: DataFrame) -> DataFrame:
    return current_from_changes(changes, "work_order_id").select(*LIVE_COLUMNS)


def recent_work_orders(orders: DataFrame, n: int = 50) -> DataFrame:
    return orders.orderBy(F.col("created_at").desc(), F.col("work_order_id").desc()).limit(n)


def open_orders_by_station(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status").isin(*_OPEN)).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("open_work_orders"))


def create_work_orders(requests: DataFrame, health: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted orders, rejected requests with a reason).

    An order takes over the station's latest risk. Requests for a station without any, or outside the allowed
    priorities, are rejected. A request without a priority gets P2, one without a text gets it from the signal to blame.
    """
    station = health.select("station_id", "plant_id", "line_id", "failure_probability", "risk_band", "top_signal")
    known = F.col("plant_id").isNotNull()
    checked = (
        requests.join(station, "station_id", "left")
        .withColumns({"status": F.lit("open"), "priority": F.coalesce("priority", F.lit("P2"))})
        .withColumn("reason", F.when(~known, "unknown station").when(~WORK_ORDER_DOMAIN.passed(), "invalid request"))
    )
    accepted = checked.filter(F.col("reason").isNull()).select(
        F.col("request_id").alias("work_order_id"), "station_id", "plant_id", "line_id", "priority", "status",
        F.col("failure_probability").cast("decimal(5,4)").alias("failure_probability"), "risk_band", "top_signal",
        text_or("description", F.concat(F.lit("Predicted "), F.col("top_signal"), F.lit(" issue"))).alias("description"),
        "created_by", F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))
    rejected = checked.filter(F.col("reason").isNotNull()).select(
        "request_id", "station_id", "priority", "reason", "created_by", "requested_at")
    return accepted, rejected


def complete_work_orders(completions: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed orders, one repair command per closed order). Completions of unknown orders have no effect."""
    kept = [c for c in orders.columns if c not in ("status", "updated_at", "completed_at")]
    closed = (
        orders.select(*kept).join(completions, "work_order_id")
        .select(*kept, F.lit("completed").alias("status"), F.col("completed_at").alias("updated_at"), "completed_at",
                "completed_by")
    )
    commands = closed.select(
        F.lit("repair").alias("command"), "station_id", F.col("completed_by").alias("requested_by"),
        F.lit("pending").alias("status"), F.col("completed_at").alias("requested_at"), "work_order_id")
    return closed.drop("completed_by"), commands


def command_history(commands: DataFrame, station_id: str) -> DataFrame:
    """Audit of one station's commands in log order."""
    return commands.filter(F.col("station_id") == station_id).orderBy("lsn")


def command_latency(commands: DataFrame) -> DataFrame:
    return commands.select(
        "command_id", "command", "station_id", "status", "requested_at", "applied_at",
        F.round(ms_between("requested_at", "applied_at") / 1000.0, 2).alias("seconds_to_apply"))


def station_grid(health: DataFrame, orders: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Latest state per station, its open orders, and one age for all: now (the newest window by default) minus the
    newest reading shown."""
    newest, now = health.agg(F.max("last_reading_ts")).scalar(), as_of_column(health, "window_end", as_of)
    grid = health.join(open_orders_by_station(orders), "station_id", "left").withColumns({"newest_ts": newest, "now": now})
    return grid.select(
        *STATION_KEYS, "failure_probability", "risk_band", "top_signal", "top_signal_deviation_pct", "window_end",
        "last_reading_ts", "avg_vibration_rms", "avg_bearing_temp_c", "avg_motor_current_a",
        "avg_hydraulic_pressure_bar",
        F.coalesce("open_work_orders", F.lit(0)).alias("open_work_orders"),
        F.round(ms_between("newest_ts", "now") / 1000.0, 1).alias("data_age_s"))
