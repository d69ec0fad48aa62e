"""Numbered versions of a folder: a version is there once its commit marker is, and is never changed afterwards."""

from collections.abc import Iterable

from pyspark.sql import SparkSession


class Versions:
    """Folders `<root>/version=<n>`, through the file system that Spark itself uses for the path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _at(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, version: int) -> str:
        return f"{self.root}/version={version:020d}"

    def committed(self) -> list[int]:
        marks, fs = self._at(f"{self.root}/version=*/_SUCCESS")
        return sorted(int(m.getPath().getParent().getName().split("=")[1]) for m in fs.globStatus(marks) or [])

    def there(self) -> list[int]:
        """All versions with a folder, committed or not."""
        folders, fs = self._at(f"{self.root}/version=*")
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.globStatus(folders) or [])

    def drop(self, versions: Iterable[int]) -> None:
        for version in versions:
            path, fs = self._at(self.path(version))
            fs.delete(path, True)
