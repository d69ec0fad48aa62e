"""Maintenance log: context, technician assignment, repair rollups."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.functions.columns import digest
from wearline.sources.refreshed import RefreshedView


def maintenance_events(log: DataFrame, station_master: DataFrame) -> DataFrame:
    """The log with its station's context; entries of unknown stations are left out."""
    stations = station_master.select(
        "station_id", "plant_id", "plant_name", "line_id", "station_type", "criticality")
    return log.join(stations, "station_id").withColumn("event_date", F.to_date("event_ts"))


def maintenance_view(spark: SparkSession, root: str) -> RefreshedView:
    """`maintenance_events`, stored and refreshed by new files of the log."""
    return RefreshedView(spark, root, maintenance_events)


def repairs_by_type(log: DataFrame, station_master: DataFrame) -> DataFrame:
    stations = station_master.select("station_id", "station_type")
    return (
        log.join(stations, "station_id")
        .groupBy("event_type", "station_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("downtime_min").alias("downtime_min"),
             F.sum("parts_cost_usd").alias("parts_cost_usd"))
    )


def numbered_within(df: DataFrame, group: str, key: str) -> DataFrame:
    """Number the rows of each group 1..n without bringing a whole group into one task.

    Rows are numbered inside (group, bucket), where the bucket is the start of the key's digest, and shifted by the
    size of the buckets before. Only bucket sizes, at most 256 per group, meet in one place.
    """
    rows = df.withColumn("bucket", F.substring(F.md5(F.col(key)), 1, 2))
    sizes = rows.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("bucket_rows"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = sizes.select(
        group, "bucket",
        F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bucket_rows").over(whole).alias("group_rows"),
    )
    inside = rows.withColumn("position", F.row_number().over(Window.partitionBy(group, "bucket").orderBy(key)))
    return inside.join(offsets, [group, "bucket"]).select(
        *df.columns, (F.col("rows_before") + F.col("position")).alias("number"), "group_rows")


def assign_technician(events: DataFrame, technicians: DataFrame) -> DataFrame:
    """Give each repair a technician of the same plant, chosen by the event id alone: a re-run assigns alike.

    Failures get none. Repairs of a plant without technicians are kept, unassigned.
    """
    staff = numbered_within(
        technicians.select("technician_id", F.col("home_plant_id").alias("plant_id")), "plant_id", "technician_id")
    per_plant = staff.groupBy("plant_id").agg(F.max("group_rows").alias("staff_count"))
    drawn = events.drop("technician_id").join(per_plant, "plant_id", "left").withColumn(
        "number", F.when(F.col("event_type") != "failure", digest("event_id") % F.col("staff_count") + 1))
    return drawn.join(staff.drop("group_rows"), ["plant_id", "number"], "left").drop("number", "staff_count")
