"""Reading and writing tables as Parquet folders."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def read_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """A folder that others append Parquet files to. Without a limit one batch takes everything that is there.

    A limit bounds the size of a batch while catching up; files then have to arrive in order of event time, or their
    readings may be behind the watermark that earlier files have set.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def overwrite(
    df: DataFrame, path: str, cluster_by: Sequence[str] = (), spread_by: Sequence[Column] = (), sort_by: Sequence[str] = (),
    mode: str = "overwrite"
) -> None:
    """Replace a table, schema included; or add a part to it (`mode="append"`).

    `cluster_by` range-partitions and sorts the rows: min/max statistics let readers skip whole files. Name a second
    column (time) next to a key that may be very frequent. `spread_by` rebalances rows by hash instead, with AQE
    splitting oversized and joining undersized partitions, and sorts each file by `cluster_by`: no sampling run, right
    for tables that are mostly read as a whole. `sort_by` sorts each file and moves no row.
    """
    if spread_by:
        parts = {f"_spread_{i}": c for i, c in enumerate(spread_by)}
        df = df.withColumns(parts).hint("rebalance", *parts).drop(*parts)  # the hint takes plain columns only
    elif cluster_by:
        df = df.repartitionByRange(*cluster_by)
    if cluster_by or sort_by:
        df = df.sortWithinPartitions(*(cluster_by or sort_by))
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str, name: str) -> DataStreamWriter:
    """Exactly-once append of a stream to a folder; restarts go on from the checkpoint."""
    return (
        df.writeStream.queryName(name).format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path).option("compression", "zstd")
    )


class VersionedTable:
    """A small table that is replaced as a whole by every micro-batch.

    Each batch id has a folder of its own, valid once its commit marker exists. Replaying a batch rewrites the same
    folder from the version before it, so a retry after a lost driver changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 10):
        self.spark, self.root, self.keep = spark, root, keep

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, version: int) -> str:
        return f"{self.root}/version={version:020d}"

    def versions(self) -> list[int]:
        _, fs = self._fs()
        markers = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/version=*/_SUCCESS")) or []
        return sorted(int(m.getPath().getParent().getName().split("=")[1]) for m in markers)

    def read(self, before: int | None = None) -> DataFrame | None:
        committed = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(self._path(committed[-1])) if committed else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self._path(version))
        _, fs = self._fs()
        for old in self.versions()[: -self.keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(old)), True)
