"""Filters relative to "now", where now is a parameter and results can be repeated."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of_column(df: DataFrame, column: str, as_of: datetime | None) -> Column:
    """A literal, which reaches the Parquet reader as a filter, or the newest value in the data."""
    return F.lit(as_of) if as_of is not None else df.agg(F.max(column)).scalar()


def trailing(df: DataFrame, column: str, seconds: int, as_of: datetime | None = None) -> DataFrame:
    return df.filter(F.col(column) > as_of_column(df, column, as_of) - F.expr(f"INTERVAL {seconds} SECOND"))
