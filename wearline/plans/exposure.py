"""What a failure would cost the customers of each production line."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.functions.columns import station_position


def delivery_exposure(
    health: DataFrame, maintenance: DataFrame, line_programs: DataFrame, process_steps: DataFrame
) -> DataFrame:
    """Per line: if its riskiest station failed now, how long would the customer stand still and at what charge?

    Downtime stays unrounded until the end. A line without current risk, or whose riskiest station's type never had
    a corrective repair, does not appear. Ties in probability go to the smallest station id.
    """
    riskiest_first = Window.partitionBy("line_id").orderBy(F.col("failure_probability").desc(), "station_id")
    riskiest = (
        health.withColumn("rn", F.row_number().over(riskiest_first)).filter("rn = 1")
        .select("line_id", "plant_id", "station_id", "station_type", "risk_band", "failure_probability",
                "top_signal", station_position().alias("station_position"))
    )
    downtime = maintenance.filter(F.col("event_type") == "corrective_repair").groupBy("station_type").agg(
        F.avg("downtime_min").alias("typical_min"))
    line_risk = health.groupBy("line_id").agg(
        F.count_if(F.col("risk_band") == "HIGH").alias("high_risk_stations"),
        F.count_if(F.col("risk_band") == "ELEVATED").alias("elevated_risk_stations"))
    stop = F.greatest(F.lit(0.0), F.col("typical_min") - F.col("jis_buffer_min"))
    charge = stop * F.col("line_stop_charge_usd_per_min")
    return (
        line_programs.join(riskiest, "line_id")
        .join(process_steps.drop("station_type"), "station_position")
        .join(downtime, "station_type")
        .join(line_risk, "line_id")
        .select(
            "line_id", "plant_id", "customer", "vehicle_program", "part_family",
            F.col("station_id").alias("riskiest_station_id"), F.col("process_step").alias("riskiest_process_step"),
            "critical_quality_characteristic", F.col("risk_band").alias("riskiest_risk_band"),
            F.round("failure_probability", 4).alias("riskiest_failure_probability"), "top_signal",
            "high_risk_stations", "elevated_risk_stations", "jis_buffer_min",
            F.round("typical_min", 0).alias("typical_unplanned_downtime_min"),
            F.round(stop, 0).alias("line_stop_min_if_fails"), "line_stop_charge_usd_per_min",
            F.round(charge, 0).alias("exposure_usd_if_fails"),
            F.round(F.col("failure_probability") * charge, 0).alias("risk_weighted_exposure_usd"),
        )
    )


def exposure_by_customer(exposure: DataFrame) -> DataFrame:
    return exposure.groupBy("customer").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("high_risk_stations").alias("high_risk_stations"),
        F.sum("exposure_usd_if_fails").alias("exposure_usd_if_riskiest_fail"),
        F.sum("risk_weighted_exposure_usd").alias("risk_weighted_exposure_usd"))


def _per_failure(maintenance: DataFrame, line_programs: DataFrame) -> DataFrame:
    average = maintenance.filter(F.col("event_type") == "corrective_repair").agg(F.avg("downtime_min"))
    stop = F.greatest(F.lit(0.0), F.col("dt") - F.col("jis_buffer_min"))
    return line_programs.withColumn("dt", average.scalar()).withColumns(
        {"stop_min": stop, "charge": stop * F.col("line_stop_charge_usd_per_min")})


def contract_exposure(maintenance: DataFrame, line_programs: DataFrame) -> DataFrame:
    """Charge of one unplanned failure per line at the average corrective downtime, whatever the current risk."""
    return _per_failure(maintenance, line_programs).select(
        "line_id", "customer", "vehicle_program", "jis_buffer_min",
        F.round("dt", 0).alias("avg_unplanned_downtime_min"), F.round("stop_min", 0).alias("line_stop_min"),
        F.round("charge", 0).alias("charge_usd_per_failure"))


def contract_exposure_fleet(maintenance: DataFrame, line_programs: DataFrame) -> DataFrame:
    return _per_failure(maintenance, line_programs).agg(
        F.round(F.avg("stop_min"), 1).alias("avg_line_stop_min"),
        F.round(F.avg("charge"), 0).alias("avg_charge_usd_per_failure"))
