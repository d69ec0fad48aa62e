"""Near-duplicate components by fast similarity sketching, banding and exact verification.

Sketch. t coordinates are bins; round i < t throws every shingle into a random bin with value i + a random fraction,
round t + k throws all shingles into bin k. A bin keeps its least value, and the rounds end once every bin is filled:
after about ln(t) throws per bin. Two sets agree in a bin with probability equal to their Jaccard similarity, and the
share of equal bins is concentrated as for t independent samples.

Candidates. Bands of `rows` bins; the number of bands makes the chance to miss a pair at the threshold at most `miss`.
Equal sets are one node from the start. In each bucket all members are compared with one leader, on their full sets;
links give components. A bucket whose other members still lie in different components gets another leader, from the
largest component there, and after `LEADERS` leaders the rest of it is compared block by block, all pairs of two blocks
by one matrix product, and links across components are kept. So no link that shares a bucket is lost, while a bucket of one component costs one comparison per member.

Memory and skew. Buckets are joined with their leaders (Spark splits large ones), members of a leader are dealt over
many tasks and streamed past the leader's set. Only documents that share a bucket with another have their sets stored.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; rows of one id are one
document, linked by any of its texts; a null id has no component (null) and is kept; equal sets are linked whatever the
texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import stored, text_or_empty, trimmed
from wearline.llm.components import components

ROWS = 5
MISS = 1e-6
#: Leaders of a bucket before its rest is compared in blocks.
LEADERS = 2
#: Members of one block, and elements whose presence is multiplied at once.
BLOCK = 384
COLUMNS = 8192
#: Tasks over which the members of one leader are dealt.
SALTS = 64
#: Words a worker remembers the hashes of.
REMEMBERED = 1_000_000


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands such that a pair of this similarity shares none with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log1p(-similarity ** rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles of whole texts."""

    def __init__(self, width: int):
        self.width = width
        self._known: dict[bytes, int] = {}

    def _hash(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, text: str) -> np.ndarray:
        """Distinct 64-bit hashes, ascending; fewer words than the width are one shingle."""
        words = text.encode("utf-8").lower().split()  # of bytes: A-Z alone, and exactly space and \x09 to \x0D
        hashes = self._hash(words)
        width = min(self.width, len(words))
        if not width:
            return np.empty(0, dtype=np.uint64)
        total = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(words) - width + 1 + k])
        return np.unique(total)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Bins of a set: the round in the upper bits, the fraction in the lower 40. All bins are filled."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(size, empty, dtype=np.uint64)
    low = np.uint64((1 << 40) - 1)
    done = 0
    at_once = max(1, math.ceil(size * (math.log(size) + 2) / len(elements)))
    while done < size and (bins == empty).any():
        turns = np.arange(done, min(size, done + at_once), dtype=np.uint64)
        h = _mix(elements[None, :] + (turns[:, None] + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        place = (h >> np.uint64(40)) % np.uint64(size)
        np.minimum.at(bins, place.ravel().astype(np.int64), ((turns[:, None] << np.uint64(40)) | (h & low)).ravel())
        done += len(turns)
    for k in np.flatnonzero(bins == empty):
        h = _mix(elements + np.uint64((size + int(k) + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        bins[k] = np.uint64(size + int(k) << 40) | (h & low).min()
    return bins


def band_keys(bins: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bands = bins.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for ascending arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b) or not len(a):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)


def all_similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For all pairs of sets at once, whether they are similar: exact counts of common elements by matrix products.

    Elements of one set alone cannot be common and are left out; the others are taken `COLUMNS` at a time.
    """
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, len(shared), COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        holds = np.zeros((len(sets), min(COLUMNS, len(shared) - at)), dtype=np.float32)
        holds[row[here], column[here] - at] = 1
        common += holds @ holds.T  # whole numbers below 2^24: exact
    both = sizes[:, None] + sizes[None, :] - common
    return (100.0 * common.astype(np.float64) >= percent * both) & (sizes > 0)[:, None]


def _sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of every row; the last two are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            counts, keys, band_lists = [], [], []
            for text in batch.column(1).to_pylist():
                elements = shingler.shingles(text)
                counts.append(len(elements))
                keys.append(xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None)
                band_lists.append(band_keys(sketch(elements, bands * rows), rows) if len(elements) else None)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                                   pa.array(band_lists, pa.list_(pa.int64()))],
                                  ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(trimmed(run), "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, elements): the full sets, as bytes of ascending 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            elements = [shingler.shingles(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(elements, pa.binary())], ["node", "elements"])

    return docs.mapInArrow(trimmed(run), "node long, elements binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (leader, node) that are similar, as edges (a, b)."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    members = pairs.select("leader", "node", salt.alias("salt")).join(sets, "node").select(
        "leader", "salt", "node", "elements")
    leaders = pairs.select("leader", salt.alias("salt")).distinct().join(
        sets, F.col("leader") == F.col("node")).select("leader", "salt", F.lit(None).cast("long").alias("node"), "elements")
    stream = leaders.unionByName(members).repartition("leader", "salt").sortWithinPartitions(
        "leader", "salt", F.col("node").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []  # the leader's sets: more than one if its id has several rows
        for batch in batches:
            a, b = [], []
            leader, salt, node = (batch.column(c).to_pylist() for c in ("leader", "salt", "node"))
            elements = batch.column("elements")
            for k, here in enumerate(zip(leader, salt)):
                values = np.frombuffer(elements[k].as_buffer(), dtype=np.uint64)
                if here != now:
                    now, own = here, []
                if node[k] is None:
                    own.append(values)
                elif any(similar(values, o, percent) for o in own):
                    a.append(here[0])
                    b.append(node[k])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return stream.mapInArrow(trimmed(compare), "a long, b long")


def _rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components among all members (bucket, node, label) of buckets, block by block."""
    blocks = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    dealt = members.join(blocks, "bucket").withColumn(
        "_own", F.pmod(F.xxhash64("node"), F.col("_blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("bucket", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
                         F.col("_own").alias("own"), "label", "node").join(sets, "node")

    def compare(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        node, label, own = (group.column(c).to_pylist() for c in ("node", "label", "own"))
        linked = all_similar([np.frombuffer(e.as_buffer(), dtype=np.uint64) for e in group.column("elements")], percent)
        root = {x: x for x in label}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        for p in range(len(node)):
            for q in np.flatnonzero(linked[p, :p]).tolist():
                if (i == j or own[p] != own[q]) and find(label[p]) != find(label[q]):
                    root[find(label[p])] = find(label[q])
                    a.append(node[p])
                    b.append(node[q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3,
                    percent: int = 85, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id of its component), kept."""
    bands = bands_for(percent / 100, rows, miss)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows_ = stored(_sketches(texts, width, bands, rows), "sketches")
    full = rows_.where("set_key is not null and doc_id is not null")
    least = full.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    known = stored(full.select("doc_id", "set_key").join(least, "set_key").select("doc_id", "set_key", "node"), "nodes")

    # Rows of one id with different sets: their nodes are one document.
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_most")).where("a <> _most")
    links = stored(known.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "links")

    buckets = full.join(least, (full.doc_id == least.node) & (full.set_key == least.set_key)).select(
        "node", F.explode("bands").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("_most")).where(
        "leader <> _most")
    members = stored(buckets.join(shared, "bucket").select("bucket", "node", "leader"), "members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = stored(_sets(texts.join(wanted, "doc_id").select("doc_id", "text"), width), "sets")

    pairs = members.where("node <> leader").select("leader", "node").distinct()
    links = stored(links.union(_verified(pairs, sets, percent)), "links")
    labels = components(links)
    for turn in range(LEADERS):
        # What is left of a bucket without its leaders, where it still holds different components.
        left = members.where("node <> leader").select("bucket", "node")
        left = left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        left = stored(left, "left")
        open_ = left.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high")
        left = left.join(open_.select("bucket"), "bucket")
        if not left.take(1):
            break
        if turn == LEADERS - 1:
            links = stored(links.union(_rest(left, sets, percent)), "links")
        else:
            sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
            ranked = left.join(sizes, "label", "left").withColumn("_size", F.coalesce("_size", F.lit(1)))
            chosen = ranked.groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("leader"), F.col("label").alias(
                "leader_label")), F.struct("_size", F.xxhash64("node"), "node")).alias("c")).select("bucket", "c.*")
            members = stored(left.join(chosen, "bucket"), "members")
            pairs = members.where("label <> leader_label").select("leader", "node").distinct()
            links = stored(links.union(_verified(pairs, sets, percent)), "links")
        labels = components(links)

    ends = known.join(labels, "node", "left").select(
        F.col("doc_id").alias("_id"), F.coalesce("label", "node").alias("_component")).distinct()
    result = rows_.join(ends, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("_component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
