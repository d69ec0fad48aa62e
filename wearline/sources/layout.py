"""A layout by two keys at once: files that are narrow in both, so that filters on either one skip most files."""

import os
from bisect import bisect_left, bisect_right
from math import inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CODE_BYTES = 6  # whole numbers that a double holds exactly


def text_code(column: str, first: str, last: str) -> Column:
    """A number that rises with the text: the bytes that follow the start common to the first and the last of all texts.
    Texts that differ only further on share a number; they are told apart by the sort, not by the curve."""
    common = len(os.path.commonprefix([first.encode(), last.encode()]))
    tail = F.substring(F.encode(column, "utf-8"), common + 1, _CODE_BYTES)
    return F.conv(F.hex(F.rpad(tail, F.lit(_CODE_BYTES), F.unhex(F.lit("00")))), 16, 10).cast("double")


def curve_place(x: Column, y: Column, bits: int) -> Column:
    """The place of a cell on Hilbert's curve over 2^bits x 2^bits cells. Neighbours on the curve are neighbours in the
    plane, so any stretch of it is compact; a curve of interleaved bits jumps, and files across a jump are wide."""
    side = 2**bits

    def step(state: Column, s: Column) -> Column:
        x, y = state["x"], state["y"]
        right, upper = x.bitwiseAND(s) > 0, y.bitwiseAND(s) > 0
        quarter = F.when(right, F.when(upper, 2).otherwise(3)).otherwise(F.when(upper, 1).otherwise(0))
        turned = F.when(upper, F.struct(x.alias("x"), y.alias("y"))).when(
            right, F.struct((side - 1 - y).alias("x"), (side - 1 - x).alias("y"))).otherwise(
            F.struct(y.alias("x"), x.alias("y")))
        return F.struct(turned["x"].alias("x"), turned["y"].alias("y"), (state["place"] + s * s * quarter).alias("place"))

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("place"))
    halves = F.array(*[F.lit(2**b).cast("bigint") for b in reversed(range(bits))])
    return F.aggregate(halves, start, step, lambda state: state["place"])


def overwrite_by_curve(df: DataFrame, path: str, key: str, time: str, files: int, bits: int = 8) -> None:
    """Replace a table, cut into `files` ranges along the curve over (key, time), each sorted by key and time.

    A value's place on its axis of 2^bits steps is the share of rows with smaller values and half of those with the same,
    by approximate quantiles, so a frequent key or a busy hour takes as much of the curve as it has rows; a key with more
    rows than a file holds is cut by time. Rows without a key or a time lie at the end of that axis.
    """
    first, last = df.agg(F.min(key), F.max(key)).first()
    placed = df.withColumns({"_x": text_code(key, first or "", last or ""), "_y": F.unix_seconds(time).cast("double")})
    places = []
    for axis, cuts in zip(("_x", "_y"), placed.approxQuantile(
            ["_x", "_y"], [i / 2**bits for i in range(1, 2**bits)], 0.25 / 2**bits)):
        distinct = sorted(set(cuts))
        steps = [0, *((bisect_left(cuts, c) + bisect_right(cuts, c)) // 2 for c in distinct), 2**bits - 1]
        bucketed = Bucketizer(splits=[-inf, *distinct, inf] if distinct else [-inf, 0.0, inf], inputCol=axis,
                              outputCol=f"_bucket{axis}", handleInvalid="keep")
        placed = bucketed.transform(placed)
        places.append(F.get(F.lit(steps), F.col(f"_bucket{axis}").cast("int")) if distinct else F.lit(0))
    # The curve is followed once per cell, 4^bits of them, and not once per row: one value inside the plan.
    side, cell = 2**bits, F.col("id")
    cells = df.sparkSession.range(side * side).select(
        cell.alias("_cell"), curve_place(F.floor(cell / side), cell % side, bits).alias("_place"))
    along = cells.agg(F.array_sort(F.collect_list(F.struct("_cell", "_place")))["_place"]).scalar()
    at = (places[0] * side + places[1]).cast("int")
    ranged = placed.withColumn("_place", F.get(along, at)).repartitionByRange(files, "_place", key, time)
    ranged.select(*df.columns).sortWithinPartitions(key, time).write.mode("overwrite").parquet(path)


def file_spans(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row per file that holds rows: the least and greatest value of columns, as in the file's own statistics."""
    spans = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"), *spans)


def share_skipped(spans: DataFrame, column: str, low: Column, high: Column) -> Column:
    """Share of files that a filter `column` BETWEEN low AND high need not read, inside the plan."""
    read = (F.col(f"min_{column}") <= high) & (F.col(f"max_{column}") >= low)
    return spans.agg(1 - F.avg(F.coalesce(read, F.lit(False)).cast("double"))).scalar()
