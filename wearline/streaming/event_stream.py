"""The event log as a stream of JSON lines: counts per rule that are kept up to date, and unreadable lines counted."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from wearline.plans.observability import parsed_event_log
from wearline.schemas import EVENT_LOG, EXPECTATION_COUNTS
from wearline.sources.keyed_store import KeyedStore

BROKEN, UNREADABLE, LINE_RULE = "_broken", "(unreadable)", "readable_line"
ROLLUP_KEYS, ROLLUP_ORDER = ("flow_name", "expectation"), ("seen",)


def read_event_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of files of JSON lines. A line that is cut short, no JSON, or wrong in the type of a field comes with its
    text in `_broken`; fields beyond the schema are left out, missing ones are NULL, blank lines are no lines.

    Lines are parsed as an expression: a scan of JSON leaves fields alone that a query does not use, so whether a line is
    broken would depend on the query.
    """
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    schema = StructType([*EVENT_LOG.fields, StructField(BROKEN, StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    return reader.text(folder).where(F.trim("value") != "").select(parsed.alias("line")).select("line.*")


def rule_totals(events: DataFrame) -> DataFrame:
    """Passed and failed rows per flow and rule. An unreadable line fails the rule `readable_line` of no flow.

    As a stream the state holds one row per flow and rule; `seen` grows with every change of a row.
    """
    broken = F.col(BROKEN).isNotNull()
    one_line = F.array(F.struct(
        F.lit(LINE_RULE).alias("name"), F.lit(None).cast("string").alias("dataset"),
        F.lit(0).cast("bigint").alias("passed_records"), F.lit(1).cast("bigint").alias("failed_records")))
    reported = F.when(F.col("event_type") == "flow_progress", F.col("d.flow_progress.data_quality.expectations"))
    rules = parsed_event_log(events).select(
        F.when(broken, F.lit(UNREADABLE)).otherwise(F.col("flow_name")).alias("flow_name"),
        F.inline(F.when(broken, one_line.cast(EXPECTATION_COUNTS)).otherwise(reported)))
    return rules.groupBy("flow_name", F.col("name").alias("expectation")).agg(
        F.sum("passed_records").alias("passed"), F.sum("failed_records").alias("failed"),
        F.count(F.lit(1)).alias("seen"))


def dq_rollup_stream(events: DataFrame, store: KeyedStore, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch hands over the rows that it has changed; a batch that is replayed changes nothing."""
    return (
        rule_totals(events).writeStream.queryName("dq_rollup").outputMode("update").foreachBatch(store.merge)
        .option("checkpointLocation", checkpoint)
    )
