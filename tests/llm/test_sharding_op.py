import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF
from wearline.llm.queries import op6_sharding
from wearline.llm.sharding import assign_shards, grown_shard, jump_shard


def test_growing_moves_rows_only_into_the_new_shard_and_evenly(spark):
    ids = spark.range(20_000)
    rows = ids.select(*[jump_shard(F.col("id"), n).alias(f"s{n}") for n in range(1, 19)],
                      grown_shard(F.col("id"), jump_shard(F.col("id"), 16), 16).alias("grown")).toPandas()
    for n in range(1, 18):
        moved = rows[rows[f"s{n}"] != rows[f"s{n + 1}"]]
        assert (moved[f"s{n + 1}"] == n).all()
        assert abs(len(moved) / len(rows) - 1 / (n + 1)) < 0.02
    assert (rows["grown"] == rows["s17"]).all()
    assert rows["s16"].value_counts().between(1100, 1400).all()


def check(result, expected):
    """Every row once, slots gapless, equal ids in one shard."""
    rows = result.toPandas()
    found = zip(rows["doc_id"].astype("Int64"), rows["size"], rows["text_crc32"])
    assert sorted(f"{a} {b} {c}" for a, b, c in found) == sorted(f"{a} {b} {c}" for a, b, c in expected)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in rows.itertuples():
        slots[r.shard].append(r.slot)
        shard_of[str(r.doc_id)].add(r.shard)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    check(op6_sharding(spark, SF),
          [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in zip(docs["doc_id"], docs["text"])])


@pytest.mark.parametrize("copies", [1, 3, 150_000])
def test_nulls_repeats_and_clashing_names(spark, copies):
    rows = [(None, None), (None, "é"), (5, ""), (5, None), (7, "x" * 70_000), (7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = spark.range(copies).select(F.lit(9).cast("long").alias("doc_id"), F.lit("hot").alias("text"))
    docs = docs.union(hot).select("*", *[F.lit("?").alias(c) for c in ("shard", "_block", "size", "slot", "_copies")])
    ids = [(i if i is not None else None, t or "") for i, t in rows] + [(9, "hot")] * copies
    expected = [(i if i is not None else "<NA>", len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in ids]
    check(assign_shards(docs, 16), expected)


def test_empty_table(spark):
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string"), 16).count() == 0
