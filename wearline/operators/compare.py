"""Do two results hold the same rows?"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rounded(df: DataFrame, name: str, digits: int) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        # + 0.0 turns a negative zero into a plain one
        return (F.round(F.col(name).cast("double"), digits) + 0.0).cast("string").alias(name)
    return F.col(name).cast("string").alias(name)


def result_diff(actual: DataFrame, expected: DataFrame, digits: int = 2) -> DataFrame:
    """One row: both row counts, rows missing from either side (as multisets) and the verdict.

    Numbers are compared after rounding; `actual` may carry more columns than `expected`. Every distinct row is
    counted once per side before the sides meet, so repeated rows cost no extra shuffle.
    """
    columns: Sequence[str] = expected.columns

    def counted(df: DataFrame, side: int) -> DataFrame:
        rows = df.select(*[_rounded(df, c, digits) for c in columns])
        return rows.withColumns({"n_actual": F.lit(1 - side), "n_expected": F.lit(side)})

    both = counted(actual, 0).unionByName(counted(expected, 1)).groupBy(*columns).agg(
        F.sum("n_actual").alias("a"), F.sum("n_expected").alias("e"))
    gap = F.col("a") - F.col("e")
    totals = both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("actual_rows"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum(F.greatest(gap, F.lit(0))), F.lit(0)).alias("unexpected_rows"),
        F.coalesce(F.sum(F.greatest(-gap, F.lit(0))), F.lit(0)).alias("missing_rows"),
    )
    return totals.withColumn("same", (F.col("unexpected_rows") == 0) & (F.col("missing_rows") == 0))
