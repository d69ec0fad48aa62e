"""The commit history of our own streams: what file sinks and checkpoints have written down about themselves.

A file sink logs the files of each micro-batch, and the checkpoint marks the micro-batch as done. Both are read through
Spark, so they may lie in any store, and many log files are read by many tasks. Every tenth log of a sink repeats all
files before it; a file belongs to the first log that has it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOGGED = "path string, size long, modificationTime long, action string"


def _file_name(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sink_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, version, bytes): every file that a stream has committed to a folder, with its micro-batch."""
    # The file index leaves a sink's own log out on purpose, so its files are read as whole texts, one row each.
    logs = spark.createDataFrame(spark.sparkContext.wholeTextFiles(f"{path}/_spark_metadata/[0-9]*"), "log string, text string")
    version = F.regexp_extract(_file_name("log"), r"^(\d+)", 1).cast("long")
    lines = logs.select(version.alias("version"), F.explode(F.split("text", "\n")).alias("line"))
    logged = lines.where(F.col("line").startswith("{")).select("version", F.from_json("line", _LOGGED).alias("e"))
    return logged.where("e.action = 'add'").groupBy(_file_name("e.path").alias("file")).agg(
        F.min("version").alias("version"), F.min("e.size").alias("bytes"))


def stream_commits(spark: SparkSession, path: str, checkpoint: str, writer: str, user_name: str = "") -> DataFrame:
    """One row per finished micro-batch: version, ts, user_name, writer, operation, files, bytes, rows.

    A micro-batch that only moved the watermark has no files; its operation is `ADVANCE`.
    """
    done = spark.read.text(f"{checkpoint}/commits").select(
        F.col("_metadata.file_name").cast("long").alias("version"), F.col("_metadata.file_modification_time").alias("ts"))
    done = done.groupBy("version").agg(F.max("ts").alias("ts"))
    # A count by file is answered from the files' footers and holds no rows.
    counted = spark.read.parquet(path).groupBy(_file_name("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"))
    written = sink_files(spark, path).join(counted, "file", "left").groupBy("version").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    log = done.join(written, "version", "left")
    count = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("files", "bytes", "rows")}
    return log.withColumns(count).select(
        "version", "ts", F.lit(user_name).alias("user_name"), F.lit(writer).alias("writer"),
        F.when(F.col("rows") > 0, "WRITE").otherwise("ADVANCE").alias("operation"), *count)
