"""A stored view over a growing folder of files and a dimension, refreshed by what is new.

A manifest lists the input files that the view has taken in, with their sizes and times, and the fingerprint of the
dimension. A refresh compares it with a listing of the folder: new files are joined and appended as a version of their
own; a changed dimension, or an input file that was rewritten or removed, rebuilds the view. The manifest is written
last, so a refresh that was cut short is as if it had not been begun, and readers keep the version that they opened.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wearline.sources.versions import Versions

_FILE = ["path", "length", "modificationTime"]


@dataclass(frozen=True)
class Refresh:
    """`version` is what readers see now; `files` are the input files read for it."""

    version: int
    files: int
    rebuilt: bool


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder by the file index; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(*_FILE)


def fingerprint(rows: DataFrame) -> str:
    """Changes with any value of any row, but not with their order."""
    whole = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))
    count, hashes = rows.agg(F.count(F.lit(1)), whole).first()
    return f"{count}:{hashes}"


class RefreshedView:
    """`build` makes view rows out of log rows and the dimension, row by row of the log (a join, a projection)."""

    def __init__(self, spark: SparkSession, root: str, build: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 5):
        self.spark, self.build, self.keep = spark, build, keep
        self._data, self._manifests = Versions(spark, f"{root}/data"), Versions(spark, f"{root}/manifest")
        self._listings = Versions(spark, f"{root}/listing")

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._manifests.path(version))

    def _parts(self, version: int) -> list[int]:
        """Versions whose data make up this one: as many as refreshes since the last rebuild."""
        return sorted(r.part for r in self._manifest(version).select("part").distinct().toLocalIterator())

    def refresh(self, folder: str, schema: StructType, dimension: DataFrame) -> Refresh:
        last = max(self._manifests.committed(), default=None)
        version, rebuilt = 0 if last is None else last + 1, True
        # Written first: what is read and what the manifest says are the same files, whatever arrives meanwhile.
        listing(self.spark, folder).write.mode("overwrite").parquet(self._listings.path(version))
        there, mark = self.spark.read.parquet(self._listings.path(version)), fingerprint(dimension)
        new, taken = there, None
        if last is not None:
            taken = self._manifest(last)
            known = taken.select("dimension").first()
            gone = taken.join(there, _FILE, "left_anti")
            rebuilt = known is None or known.dimension != mark or bool(gone.take(1))
            new = there if rebuilt else there.join(taken, _FILE, "left_anti")
        paths = [r.path for r in new.select("path").toLocalIterator()]  # names of files to open, as a scan lists them
        if not paths and not rebuilt:
            self._listings.drop([version])
            return Refresh(last, 0, False)
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        self.build(rows, dimension).write.mode("overwrite").parquet(self._data.path(version))
        entries = new.select(*_FILE, F.lit(version).cast("long").alias("part"), F.lit(mark).alias("dimension"))
        if not rebuilt:
            entries = taken.unionByName(entries)
        entries.write.mode("overwrite").parquet(self._manifests.path(version))
        self._forget()
        return Refresh(version, len(paths), rebuilt)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The view as of a version, the newest by default; what is read stays as it is during later refreshes."""
        committed = self._manifests.committed()
        if not committed:
            return None
        version = committed[-1] if version is None else version
        parts = self._parts(version) or [version]
        return self.spark.read.parquet(*map(self._data.path, parts))

    def _forget(self) -> None:
        committed = self._manifests.committed()
        kept = committed[-self.keep:]
        used = {part for version in kept for part in self._parts(version) or [version]}
        self._listings.drop(self._listings.there())
        self._manifests.drop(set(committed) - set(kept))
        self._data.drop(v for v in self._data.there() if v < kept[-1] and v not in used)
