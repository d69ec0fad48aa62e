"""What several operators share: reading tables, null-safe columns, the shared folder for cut lineage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.session import workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame, written once to the shared folder and read back: cuts the lineage and survives lost executors.

    The folder is `spark.checkpoint.dir` of the session (see `wearline.session.workspace`).
    """
    spark = df.sparkSession
    path = workspace(spark, "llm", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where the C library can do that."""
    gc.collect()
    if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
        library.malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function over batches; at its end the worker gives back what it has freed. Workers wait for tasks of other
    stages, in which the JVM may need the room."""
    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            give_back()

    return whole
