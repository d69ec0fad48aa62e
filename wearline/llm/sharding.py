"""Shards by jump consistent hashing, as column expressions only.

The jump walk of a key visits buckets 0 = b0 < b1 < ...; from bucket b it jumps to floor((b + 1) / u) with u the
key's own pseudo-random number for b in (0, 1]. With n shards a row lies in the last bucket below n, so one more
shard takes rows only into itself and no table of ring positions exists. u comes from `xxhash64(key, b)`, which is
the generator Spark evaluates inside generated code.

Defined cases: a null key is a key like any other (all null keys share a shard); equal keys share a shard, and with
them all repeats; a null text has size 1 and the checksum of the empty text; an empty table gives an empty result;
columns that are not named in the arguments are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm.common import text_or_empty

#: Blocks of a shard in which slots are counted independently. Offsets are one row per shard and block, whatever
#: the number of documents.
BLOCKS = 4096
#: Most copies of one identical row that one generated array holds.
COPIES = 65536


def _jump(key: Column, bucket: Column) -> Column:
    """The bucket to which the walk of `key` jumps from `bucket`."""
    bits = F.shiftrightunsigned(F.xxhash64(key, bucket), 11)
    share = (bits + 1).cast("double") / F.lit(float(2 ** 53))
    return F.least(F.floor((bucket + 1).cast("double") / share), F.lit(2 ** 62)).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a key among `shards`: at most `shards` - 1 jumps, ln(shards) on average."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    if shards == 1:
        return F.lit(0).cast("int")

    def step(bucket: Column, _: Column) -> Column:
        onward = _jump(key, bucket)
        return F.when(onward < shards, onward).otherwise(bucket)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards - 1)), F.lit(0).cast("long"), step).cast("int")


def grown_shard(key: Column, shard: Column, shards: int) -> Column:
    """Shard of the same key among `shards` + 1: its own, or the new one."""
    return F.when(_jump(key, shard.cast("long")) == shards, F.lit(shards)).otherwise(shard).cast("int")


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot, grown_shard.

    `slot` numbers the rows of a shard from 0 without gaps. Identical rows are counted before they are shuffled, so a
    row repeated any number of times is one row per task there; slots are then counted per block of a shard and moved
    by the rows of the blocks before, so no shard is ever in one task.
    """
    content = F.encode(text_or_empty(text), "UTF-8")
    rows = docs.select(
        F.col(key).alias("_key"), (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content).alias("text_crc32"))
    rows = rows.withColumn("shard", jump_shard(F.col("_key"), shards))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key", "size", "text_crc32"), F.lit(BLOCKS)).cast("int"))
    counted = rows.groupBy("shard", "_block", "_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
    counted = counted.repartition("shard", "_block")
    offsets = counted.groupBy("shard", "_block").agg(F.sum("_copies").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_block").orderBy("_key", "size", "text_crc32").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    placed = placed.join(offsets, ["shard", "_block"]).withColumn("_first", F.col("_offset") + F.col("_before"))
    last = F.col("_copies") - 1
    placed = placed.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / COPIES))))
    start = F.col("_chunk") * COPIES
    placed = placed.withColumn("_copy", F.explode(F.sequence(start, F.least(last, start + (COPIES - 1)))))
    return placed.select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_first") + F.col("_copy")).alias("slot"),
        grown_shard(F.col("_key"), F.col("shard"), shards).alias("grown_shard"))
