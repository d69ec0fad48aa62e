"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by dense prefix-suffix tiling.

1. Words are counted: each task counts runs of letters in a dictionary of bounded size, so a frequent word is a few rows
   per task, and only counts are shuffled. Everything after works on the vocabulary, not on the corpus.
2. Two words of which the longer has c code points differ by a single edit exactly if common prefix and common suffix
   together reach c - 1. Then one of them reaches half of that: words meet that share the first or the last half, within
   words of c and c - 1 code points. A group of more than `TILE` words is halved again, by what its words share of the
   open middle, until it is small or the middle is one code point, where no group exceeds the alphabet. So no group is
   ever compared as a whole with itself beyond `TILE` words, and no pair is lost.
3. Groups lie one after the other in tiles: two matrices of code points (letters up to U+00FF, one byte each), padded on
   the right and on the left. A tile is compared with itself shifted by 1, 2, ... rows, and the first unequal column from
   either side gives common prefixes and suffixes of all pairs at once. Every pair is reported by one group only: the one
   on the way that follows its prefix wherever that is long enough.
4. A word's form is its near word of largest count, if that is `factor` times as frequent; roots follow forms by pointer
   doubling (counts grow on the way, so it ends after few rounds).

Defined cases: null and empty texts have no words; a null id is empty in the drawn text; repeated rows count each; texts
and words of any length are taken whole; ties between forms go to the smaller word in code-point order; an empty table
gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import stored

#: Fixed value: letters of a run. All of them are below U+0100.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One run in so many loses a code point.
DAMAGED = 31
#: Different words a task counts before it passes them on, and runs taken from a text at once.
COUNTED, RUNS = 200_000, 100_000
TOGETHER = 64
#: Largest group compared densely, rows of a tile, and bytes of one of its matrices (a single group may exceed both).
TILE, TILE_ROWS, TILE_BYTES = 1024, 4096, 4 << 20
#: Pairs compared at once.
AT_ONCE = 1 << 16


def count_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH,
                damaged: int = DAMAGED) -> DataFrame:
    """(word, n): runs of at least `least` letters, A-Z lower-cased, some damaged by a draw from id and run."""
    found = re.compile(f"[{LETTERS}]{{{least},}}")

    def words(doc_id: object, content: str) -> Iterator[tuple[bytes, int]]:
        seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
        runs = (m.group() for m in found.finditer(content))
        while some := Counter(islice(runs, RUNS)):
            for run, n in some.items():
                low = run.encode("latin-1").lower()
                draw = crc32(low if low.isascii() else low.decode("latin-1").encode(), seed)
                if draw % damaged == 0:
                    at = draw % len(low)
                    low = low[:at] + low[at + 1:]
                    if len(low) < least:
                        continue
                yield low, n

    def written(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array([w.decode("latin-1") for w in counts], pa.string()),
                                "n": pa.array(list(counts.values()), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                for doc_id, content in zip(*(c.to_pylist() for c in batch.slice(at, TOGETHER).columns)):
                    for word, n in words(doc_id, content):
                        counts[word] += n
                        if len(counts) >= COUNTED:
                            yield written(counts)
                            counts.clear()
        if counts:
            yield written(counts)

    rows = docs.select(F.col(id_column), F.col(text).cast("string")).where(F.col(text).isNotNull())
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (c, way, a, b, word, n), of words that share `a` code points in front and `b` behind, twice: sharing more
    in front, and more behind, by half of what is missing to c - 1. `way` has a bit for each choice made, after a 1."""
    step = F.expr("int((c - a - b) div 2)")  # half of c - 1 - a - b, rounded up
    more = F.explode(F.array(
        F.struct((F.col("way") * 2).alias("way"), (F.col("a") + step).alias("a"), "b"),
        F.struct((F.col("way") * 2 + 1).alias("way"), "a", (F.col("b") + step).alias("b")))).alias("_s")
    rows = rows.select("c", more, "word", "n").select("c", "_s.*", "word", "n")
    head, tail = F.expr("left(word, a)"), F.expr("right(word, b)")
    return rows.withColumn("key", F.concat_ws(" ", "c", "way", head, tail))


def _tiles(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (key, c, way, word, n) sorted by key, in lists of whole groups."""
    tile: list[tuple] = []
    for key, group in groupby(rows, key=lambda r: r[0]):
        some = list(group)  # at most TILE words, or as many as there are letters
        if len(some) < 2:
            continue
        width = max(len(some[0][3]), len(tile[0][3]) if tile else 0) + 1
        if tile and (len(tile) + len(some) > TILE_ROWS or (len(tile) + len(some)) * width > TILE_BYTES):
            yield tile
            tile = []
        tile += some
    if tile:
        yield tile


def near_in_tile(tile: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the near pairs that are reported by their group."""
    words = [r[3].encode("latin-1") for r in tile]
    length = np.array([len(w) for w in words])
    width = int(length.max()) + 1  # the last column is padding: a word and its extension differ there at the latest
    ahead = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    behind = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    c, way = (np.array([r[k] for r in tile]) for k in (1, 2))
    group = np.cumsum([False] + [x[0] != y[0] for x, y in zip(tile, tile[1:])])
    depth = 1 << np.array([w.bit_length() - 1 for w in way.tolist()])  # ways of this many choices start here
    firsts, seconds = [], []
    shift = 1
    while True:
        together = np.flatnonzero(group[:-shift] == group[shift:])
        if not len(together):
            break
        # Two words of c - 1 are compared among those of c - 1.
        together = together[(length[together] == c[together]) | (length[together + shift] == c[together])]
        at_once = max(1, AT_ONCE * 16 // width)
        for at in range(0, len(together), at_once):
            i = together[at:at + at_once]
            j = i + shift
            prefix = (ahead[i] != ahead[j]).argmax(axis=1)
            suffix = (behind[i] != behind[j]).argmax(axis=1)
            near = prefix + suffix >= c[i] - 1
            i, j, prefix = i[near], j[near], prefix[near]
            taken, front, back = np.ones(len(i), np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            while (open_ := taken < depth[i]).any():
                step = (c[i] - front - back) // 2
                left = prefix - front >= step
                front += np.where(open_ & left, step, 0)
                back += np.where(open_ & ~left, step, 0)
                taken = np.where(open_, 2 * taken + ~left, taken)
            own = taken == way[i]
            firsts.append(i[own])
            seconds.append(j[own])
        shift += 1
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(firsts), np.concatenate(seconds)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of different words one edit apart, once each.

    `words` has each word once, of letters up to U+00FF."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(rows_of(batches)):
            i, j = near_in_tile(tile)
            if len(i):
                one, two = np.concatenate([i, j]), np.concatenate([j, i])
                word, n = pa.array([r[3] for r in tile], pa.string()), pa.array([r[4] for r in tile], pa.int64())
                yield pa.record_batch({"word": word.take(one), "n": n.take(one), "near": word.take(two), "near_n": n.take(two)})

    length = F.char_length("word")
    start = words.select(F.explode(F.array(length, length + 1)).alias("c"), F.lit(1).cast("long").alias("way"),
                         F.lit(0).alias("a"), F.lit(0).alias("b"), "word", "n")
    level = stored(_halved(start), "spelling-halves")
    ready = None
    while True:
        # Groups with an open middle of more than one code point that are too large for a tile.
        large = stored(level.groupBy("key").agg(F.count(F.lit(1)).alias("_size"), F.first(F.expr("c - 1 - a - b")).alias("_open"))
                       .where((F.col("_size") > TILE) & (F.col("_open") > 0)).select("key"), "spelling-large")
        if not large.take(1):
            ready = level if ready is None else ready.unionByName(level)
            break
        small = level.join(large, "key", "left_anti").select(level.columns)
        ready = small if ready is None else ready.unionByName(small)
        level = stored(_halved(level.join(large, "key", "left_semi")), "spelling-halves")
    tiles = ready.select("key", "c", "way", "word", "n").repartition("key").sortWithinPartitions("key", "word")
    return tiles.mapInArrow(compare, "word string, n long, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row (word, form): the end of the chain of forms."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                              F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        at = moved.select("word", "root")
        if not moved.where("_moved").take(1):
            return at


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT,
                      factor: int = 10) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = stored(count_words(docs, id_column, text).where(F.col("n") >= least_count), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("_least"), F.col("near"))).alias("_best")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    known = words.join(near, "word", "left").withColumn("form_n", -F.col("_best._least"))
    has = F.col("form_n") >= factor * F.col("n")
    known = stored(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("_best.near")).alias("form"),
        F.when(has, F.col("form_n")).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
