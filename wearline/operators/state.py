"""Current state out of histories and change logs."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The row with the greatest `order` per key. One aggregate: each task passes on one row per key."""
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return newest.select("row.*")


def current_from_changes(changes: DataFrame, key: str) -> DataFrame:
    """Change log -> live rows. Images from before an update never count; a key whose last change is a delete is gone.
    """
    effective = changes.filter(F.col("change_type").isin("insert", "update_postimage", "delete"))
    return latest_per_key(effective, [key], "lsn", "changed_at").filter(F.col("change_type") != "delete")
