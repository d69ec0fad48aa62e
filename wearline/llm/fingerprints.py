"""Document fingerprints by consistent weighted sampling.

A document is its words (runs of letters, digits and underscores, lower-cased), each weighted by how often it occurs.
Coordinate d of the signature samples one (word, level) pair: with r, c from Gamma(2, 1) and b uniform, all drawn from
the word and d alone, t = floor(ln(weight) / r + b) and ln(a) = ln(c) - r (t - b) - r; the least a wins. Two documents
agree in a coordinate with a probability equal to their generalised Jaccard similarity, sum of minima over sum of
maxima of weights. Since a depends on (word, t) alone, its value (in single precision) names the sample; 16 bits of its hash are kept.

Defined cases: a null text is the empty text; a text without words has the empty fingerprint, which is like itself (1)
and unlike all others (0); equal texts have equal fingerprints, whatever their row; other columns are ignored.
`neighbour_fingerprints` orders rows by descending id, nulls last, ties by descending text; the last row's neighbour
is the first row (a single row is its own).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import text_or_empty

COORDINATES = 128
#: Samples a worker remembers, one row of coordinates for each word and weight. When they are full, the half used most stays.
REMEMBERED = 100_000
#: Rows of samples that are compared at once: they stay in a core's cache.
COMPARED = 256
#: Terms whose samples are drawn at once: their arrays stay in a core's cache.
IN_CACHE = 256
#: Documents whose samples are drawn together.
TOGETHER = 128
#: Rows of a block of neighbouring ids, at most (rows of one id stay together).
BLOCK_ROWS = 2048
#: Blocks, about; each task gets the greatest id of all (8 bytes each). Beyond it blocks have more rows, all alike.
BROADCAST_HEADS = 65_536

_WORDS = re.compile(r"\w+")
#: Lower case of each Latin-1 character of a word (Latin-1 as well), a space for every other character.
_LATIN = "".join(chr(c).lower() if _WORDS.match(chr(c)) else " " for c in range(256)).encode("latin-1")


def weights(text: str) -> Counter:
    try:
        return Counter(text.encode("latin-1").translate(_LATIN).decode("latin-1").split())
    except UnicodeEncodeError:
        return Counter(_WORDS.findall(text.lower()))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit. Works in place on an array of its own."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _bits(seed: np.ndarray, draw: int) -> np.ndarray:
    return _mix(seed + np.uint64(draw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """A uniform number in (0, 1) of 23 bits, in single precision, out of each 32 bits."""
    uniform = (bits >> np.uint32(9)).astype(np.float32)
    uniform += np.float32(0.5)
    uniform *= np.float32(2.0 ** -23)
    return uniform


def _gamma(seed: np.ndarray, draw: int) -> np.ndarray:
    """Gamma(2, 1) out of the two halves of 64 bits."""
    halves = _uniform(_bits(seed, draw).view(np.uint32))
    drawn = halves[:, ::2] * halves[:, 1::2]
    np.log(drawn, out=drawn)
    return np.negative(drawn, out=drawn)


def samples(terms: list[tuple[str, float]], coordinates: int = COORDINATES) -> np.ndarray:
    """ln(a) of each weighted term in each coordinate."""
    keys = np.frombuffer(b"".join([hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                                   for w, _ in terms]), dtype="<u8")
    weight = np.log(np.array([w for _, w in terms], dtype=np.float64)).astype(np.float32)[:, None]
    places = np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    out = np.empty((len(terms), coordinates), dtype=np.float32)
    for at in range(0, len(terms), IN_CACHE):
        part = slice(at, at + IN_CACHE)
        seed = _mix(keys[part, None] + places[None, :])
        r, c = _gamma(seed, 1), _gamma(seed, 2)
        b = _uniform(_bits(seed, 3).astype(np.uint32))  # the lower half
        t = weight[part] / r
        t += b
        np.floor(t, out=t)
        t -= b
        t *= r
        np.log(c, out=c)
        c -= t
        np.subtract(c, r, out=out[part])
    return out


class Sketcher:
    """Signatures of many documents; samples of frequent terms are drawn once per worker."""

    def __init__(self, coordinates: int = COORDINATES):
        self.coordinates = coordinates
        # A word that occurs once is its own key: a text knows its hash, a pair does not.
        self._row: dict[str | tuple[str, float], int] = {}
        self._table = np.empty((REMEMBERED, coordinates), dtype=np.float32)
        self._uses = np.zeros(REMEMBERED, dtype=np.int64)
        self._compared = np.empty((COMPARED, coordinates), dtype=np.float32)

    def _make_room(self, wanted: int) -> None:
        """Keep the half of the samples used most, the most used first, and have room for `wanted` more."""
        order = np.argsort(-self._uses[:len(self._row)], kind="stable")[:len(self._table) // 2]
        place = np.full(len(self._row), -1)
        place[order] = np.arange(len(order))
        place = place.tolist()
        self._row = {term: place[at] for term, at in self._row.items() if place[at] >= 0}
        kept, uses = self._table[order], self._uses[order] // 2
        room = len(self._table)
        if len(kept) + wanted > room:  # very long documents: room for all of them
            room = len(kept) + wanted
            self._table = np.empty((room, self.coordinates), dtype=np.float32)
        self._table[:len(kept)] = kept
        self._uses = np.zeros(room, dtype=np.int64)
        self._uses[:len(kept)] = uses

    def _rows(self, terms: list) -> np.ndarray:
        rows = np.fromiter(map(self._row.get, terms, repeat(-1)), dtype=np.int64, count=len(terms))
        places = np.flatnonzero(rows < 0)
        missing = {terms[i] for i in places.tolist()}
        if not missing:
            return rows
        if len(self._row) + len(missing) > len(self._table):
            self._make_room(len(set(terms)))
            missing, places = set(terms).difference(self._row), np.arange(len(terms))
        first, new = len(self._row), list(missing)
        self._table[first:first + len(new)] = samples(
            [(term, 1) if isinstance(term, str) else term for term in new], self.coordinates)
        self._row.update(zip(new, range(first, first + len(new))))
        rows[places] = [self._row[terms[i]] for i in places.tolist()]
        return rows

    def _least(self, rows: np.ndarray, out: np.ndarray) -> None:
        """The minimum over rows of the table, some at a time in an array that is used again."""
        out.fill(np.inf)
        for at in range(0, len(rows), COMPARED):
            some = rows[at:at + COMPARED]
            taken = self._compared[:len(some)]
            np.take(self._table, some, axis=0, out=taken, mode="clip")
            np.minimum(out, taken.min(axis=0), out=out)

    def signatures(self, documents: list[Counter]) -> list[np.ndarray | None]:
        """16 bits per coordinate; None for a document without terms."""
        out: list[np.ndarray | None] = [None] * len(documents)
        full = [i for i, d in enumerate(documents) if d]
        for at in range(0, len(full), 16):
            some = full[at:at + 16]
            rows = self._rows([w if n == 1 else (w, n) for i in some for w, n in documents[i].items()])
            np.add.at(self._uses, rows, 1)
            ends = np.cumsum([len(documents[i]) for i in some]).tolist()
            least = np.empty((len(some), self.coordinates), dtype=np.float32)
            for k, end in enumerate(ends):
                self._least(rows[end - len(documents[some[k]]):end], least[k])
            bits = (_mix(least.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
            for k, i in enumerate(some):
                out[i] = bits[k]
        return out


def written(signature: np.ndarray | None) -> str:
    return "" if signature is None else signature.astype("<u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.mean(a == b))


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                          coordinates: int = COORDINATES) -> DataFrame:
    """One row per document: its id and its fingerprint, four hexadecimal digits per coordinate."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(coordinates)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                marks = sketcher.signatures([weights(t) for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array([written(m) for m in marks], pa.string())],
                                      [id_column, "fingerprint"])

    rows = docs.select(F.col(id_column), text_or_empty(text).alias("text"))
    return rows.mapInArrow(sketch, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, fingerprint string")


def _heads(ids: DataFrame) -> list[int]:
    """The greatest id of each block, rising. Blocks are cut by counting rows in the order of ids, so that gaps between
    ids do not matter: only rows of one id can make a block larger."""
    rows = max(BLOCK_ROWS, ids.count() // max(BROADCAST_HEADS, 1))
    falling = ids.repartitionByRange(F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc())
    # The low 33 bits count the rows of a partition, in its order.
    nth = F.monotonically_increasing_id().bitwiseAND(2 ** 33 - 1)
    return sorted({r[0] for r in falling.withColumn("_nth", nth).where(F.col("_nth") % rows == 0).collect()})


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows (_block, doc_id, text, _borrowed): blocks of neighbouring ids, each ending with a copy of the row after it.

    The row after a block is the first row of the next lower block; after the lowest block it is the first row of all.
    Rows without id are the lowest block, -1.
    """
    heads = _heads(docs.select("doc_id").where("doc_id is not null"))
    lowest = -1 if not heads or docs.where("doc_id is null").limit(1).count() else 0
    # A constant array, written compactly; folded to one literal before execution.
    known = F.split(F.lit(" ".join(map(str, heads))), " ").cast("array<bigint>") if heads else F.lit(None).cast("array<bigint>")
    # Binary search: the number of heads below the id. Beyond the last head the comparison is null.
    steps = F.array(*(F.lit(2 ** k) for k in reversed(range(max(len(heads), 1).bit_length()))))
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(known, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
    placed = docs.withColumn("_block", F.when(F.col("doc_id").isNull(), -1).otherwise(below))
    firsts = placed.where(F.col("doc_id").isNull() | (F.get(known, F.col("_block")) == F.col("doc_id")))
    after = F.when(F.col("_block") == len(heads) - 1, lowest).otherwise(F.col("_block") + 1)
    firsts = firsts.groupBy(after.alias("_block")).agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text"))
    own = placed.select("_block", "doc_id", "text", F.lit(False).alias("_borrowed"))
    return own.unionByName(firsts.select("_block", "doc_id", "text", F.lit(True).alias("_borrowed")))


def neighbour_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                           share: int = 3, coordinates: int = COORDINATES) -> DataFrame:
    """Each document against an edited version of itself and against its neighbour.

    The edited text has the last floor(length / `share`) code points replaced by the first as many of the next
    document in descending order of ids. Columns: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next. Texts move once, to blocks of neighbouring ids; ids repeated without bound make a large
    block, which is streamed, not held.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(coordinates)
        before = None  # the row whose successor comes next: block, id, text, weights, signature

        def finish(rows: list[tuple]) -> pa.RecordBatch:
            edited = []
            for _, _, content, _, following, _ in rows:
                cut = len(content) // share
                edited.append(content[:len(content) - cut] + following[:cut])
            marks = sketcher.signatures([weights(e) for e in edited])
            return pa.record_batch({
                "doc_id": pa.array([r[1] for r in rows], pa.int64()),
                "n_chars": pa.array([len(r[2]) for r in rows], pa.int64()),
                "edited_text": pa.array(edited, pa.string()),
                "fingerprint": pa.array([written(r[3]) for r in rows], pa.string()),
                "edited_fingerprint": pa.array([written(m) for m in marks], pa.string()),
                "near_edited": pa.array([likeness(r[3], m) for r, m in zip(rows, marks)], pa.float64()),
                "near_next": pa.array([likeness(r[3], r[5]) for r in rows], pa.float64())})

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                block_of, ids, texts, borrowed = (c.to_pylist() for c in batch.slice(at, TOGETHER).columns)
                marks = sketcher.signatures([weights(t) for t in texts])
                ready = []
                for block, doc_id, content, copy, mark in zip(block_of, ids, texts, borrowed, marks):
                    if before is not None and before[0] == block:
                        ready.append((*before, content, mark))
                    before = None if copy else (block, doc_id, content, mark)
                if ready:
                    yield finish(ready)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ordered = _blocks(rows).repartition("_block").sortWithinPartitions(
        "_block", "_borrowed", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return ordered.mapInArrow(
        compare, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")
