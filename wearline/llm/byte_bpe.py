"""Byte-level BPE of whole texts: overlapping chunks pre-tokenised in parallel, stitched, encoded piece by piece.

1. A text of more than `CHUNK` code points becomes overlapping chunks, which are spread over all tasks whatever the text's
   length. Each chunk is split into pre-tokens on its own; its first split may be wrong, since it starts anywhere, and its
   last ones, since it ends anywhere (`MARGIN`).
2. A split depends only on the text behind it. So where a chunk and the one before it both split, in the overlap, they
   have resynchronised, and everything after is right. Only the splits inside overlaps meet, as small rows. Chunks that
   share none (a pre-token as long as the overlap) are joined and split anew, until every seam is closed.
3. Between two seams lies a piece: its pre-tokens are encoded independently of all others. Ids are joined by document, in
   order. Short texts are one chunk and one piece: they are encoded where they are and never move.

Ids are little-endian unsigned 32-bit numbers. Decoding looks up each id's bytes and joins them; `decoded` is the text's
UTF-8 exactly. The pattern's classes are those of the encoding library: code points which the two regular expression
engines class differently (their Unicode versions differ) are replaced by stand-ins of the right class before splitting.

Defined cases: null and empty texts have no tokens; repeated rows and repeated ids are documents of their own; a null id
stays null; any length of text is encoded whole; an empty table gives no rows; other columns are ignored, whatever they
are called.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby, islice, takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm.common import stored, text_or_empty
from wearline.llm.tokens import Remembering

#: Code points of a chunk, and by how many it reaches into the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: A split this near the end of a chunk may depend on what follows (the longest fixed alternative and a look-ahead).
MARGIN = 8
#: Documents turned into Python strings at once, and pre-tokens encoded at once.
TOGETHER, TOKENS = 32, 1 << 14
#: Bytes of pre-tokens and ids that a worker remembers.
REMEMBERED_BYTES = 48 << 20
_FIRST_DIFFERENT = 0x80


class Coding(NamedTuple):
    """A vocabulary and the pattern that splits texts before its merges; the file is read by each Python worker."""
    path: str
    pattern: str


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@cache
def _stand_ins() -> dict[int, str]:
    """Code point -> a code point of the class (letter, number, neither) that the encoding library sees in it, where the
    splitting engine sees another."""
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(_FIRST_DIFFERENT, 0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    found = {}
    for name, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        # What a pattern does not match is not encoded: the ids are the bytes of the class.
        library = tiktoken.Encoding(name, pat_str=f"{name}+", mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(library.encode_ordinary(every)).decode())
        ours = set(regex.findall(name, every))
        found |= {ord(c): "" for c in ours - theirs if ord(c) not in found}
        found |= {ord(c): stand_in for c in theirs - ours}
    return found


class _Splitter:
    """Pre-tokens of a text, as the encoding library finds them."""

    def __init__(self, pattern: str):
        import regex

        self._tokens = regex.compile(pattern)
        self._table = _stand_ins()
        spans = _spans(sorted(self._table))
        self._odd = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]") if spans else None
        # First bytes of code points below all of these; taking them away is far quicker than a search.
        self._low = bytes(range(chr(spans[0][0]).encode()[0])) if spans else b""

    def _plain(self, text: str) -> str:
        if self._odd is None or text.isascii() or not text.encode().translate(None, self._low) or \
                self._odd.search(text) is None:
            return text
        return text.translate(self._table)  # as many code points as before

    def tokens(self, text: str, begin: int = 0, stop: int | None = None) -> Iterator[list[str]]:
        """Lists of consecutive pre-tokens, together the text between two splits. What lies behind `stop` is still looked
        at: white space ends differently before a word and at the end of a text."""
        plain = self._plain(text)
        stop = len(text) if stop is None else stop
        if plain is text and not begin and stop == len(text) <= CHUNK:
            yield self._tokens.findall(text)
            return
        found = takewhile(lambda m: m.start() < stop, self._tokens.finditer(plain, begin))
        while some := [text[m.start():m.end()] for m in islice(found, TOKENS)]:
            yield some

    def ends(self, text: str) -> Iterator[int]:
        return (m.end() for m in self._tokens.finditer(self._plain(text)))


def _spans(points: list[int]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for p in points:
        if spans and spans[-1][1] == p - 1:
            spans[-1] = spans[-1][0], p
        else:
            spans.append((p, p))
    return spans


class ByteCoder:
    """Ids of pre-tokens, and bytes of ids."""

    def __init__(self, coding: Coding):
        import tiktoken

        ranks = _ranks(coding.path)
        self.splitter = _Splitter(coding.pattern)
        self._merges = tiktoken.Encoding("ranks", pat_str=coding.pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self._ids = Remembering(self._encoded, REMEMBERED_BYTES)

    def _encoded(self, token: str) -> bytes:
        return np.array(self._merges._core_bpe.encode_single_piece(token.encode()), "<u4").tobytes()

    def encode(self, text: str, begin: int = 0, stop: int | None = None) -> bytes:
        ids = self._ids.__getitem__
        return b"".join(b"".join(map(ids, some)) for some in self.splitter.tokens(text, begin, stop))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[Coding, ByteCoder] = {}


def byte_coder(coding: Coding) -> ByteCoder:
    """The coder of this Python worker, loaded once."""
    if coding not in _loaded:
        _loaded[coding] = ByteCoder(coding)
    return _loaded[coding]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, TOGETHER).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes."""
    some, taken = [], 0
    for row in rows:
        some.append(row)
        taken += weight(row)
        if taken >= 4 << 20 or len(some) >= 4096:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some, taken = [], 0
    if some:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _chunks(long: DataFrame) -> DataFrame:
    """(doc, doc_id, chunk, start, until, text) of documents (doc, doc_id, text); `until` is where the next chunk starts."""
    kind = long.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("chunk", pa.int64()),
                                ("start", pa.int64()), ("until", pa.int64()), ("text", pa.string())])
            yield from _batches(((doc, doc_id, k, at, min(at + CHUNK, len(text)), text[at:at + CHUNK + OVERLAP])
                                 for doc, doc_id, text in _rows([batch])
                                 for k, at in enumerate(range(0, len(text), CHUNK))), schema, lambda r: len(r[5]))

    return long.mapInArrow(cut, f"doc long, doc_id {kind}, chunk long, start long, until long, text string")


def _with_splits(chunks: DataFrame, coding: Coding) -> DataFrame:
    """Chunks with the splits to compare: `head`, in their first code points, and `tail`, in those after `until`."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = byte_coder(coding).splitter
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                heads, tails = [], []
                for start, until, text in zip(*(part.column(c).to_pylist() for c in ("start", "until", "text"))):
                    # The last chunk ends with its text, so all of its splits hold.
                    holds = len(text) if start + len(text) == until else len(text) - MARGIN
                    head, tail = [start], []
                    for end in splitter.ends(text):
                        if end > holds:
                            break
                        if end <= OVERLAP:
                            head.append(start + end)
                        if start + end >= until:
                            tail.append(start + end)
                    heads.append(head)
                    tails.append(tail)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, lists), pa.array(tails, lists)],
                                                 [*part.schema.names, "head", "tail"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(split, f"{fields}, head array<long>, tail array<long>")


def _stitched(chunks: DataFrame, coding: Coding) -> DataFrame:
    """Chunks with `entry`, where their piece starts, and `leave`, where the next one does."""
    order = Window.partitionBy("doc").orderBy("chunk")
    chunks = stored(_with_splits(chunks, coding), "bpe-chunks")
    while True:
        splits = chunks.select("doc", "chunk", "until", "head", "tail")  # texts stay where they are
        # A chunk starts at 0, or at the first split that it shares with the chunk before.
        shared = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
        seams = splits.withColumn("entry", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(shared))
        seams = stored(seams.select("doc", "chunk", "until", "entry"), "bpe-seams")
        if not seams.where("entry is null").take(1):
            break
        # The chunks up to the next shared split are one from now on.
        joined = seams.withColumn("_run", F.sum(F.col("entry").isNotNull().cast("long")).over(order))
        joined = joined.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("doc", "_run")))
        parts = chunks.join(joined.select("doc", "chunk", "_run", "_size"), ["doc", "chunk"])
        part = F.struct("chunk", "start", "until", "text", "doc_id")
        whole = parts.where("_size > 1").groupBy("doc", "_run").agg(F.sort_array(F.collect_list(part)).alias("_p"))
        own = F.transform("_p", lambda p: F.substring(p["text"], F.lit(1), (p["until"] - p["start"]).cast("int")))
        first, last = F.element_at("_p", 1), F.element_at("_p", -1)
        text = F.concat(F.array_join(F.slice(own, F.lit(1), F.size("_p") - 1), ""), last["text"])
        whole = whole.select("doc", first["doc_id"].alias("doc_id"), first["chunk"].alias("chunk"), first["start"].alias("start"),
                             last["until"].alias("until"), text.alias("text"))
        kept = parts.where("_size = 1").select(chunks.columns)
        chunks = stored(kept.unionByName(_with_splits(whole, coding)), "bpe-chunks")
    seams = seams.withColumn("leave", F.coalesce(F.lead("entry").over(order), F.col("until"))).drop("until")
    return chunks.drop("head", "tail").join(seams, ["doc", "chunk"])


def _encoded_pieces(pieces: DataFrame, coding: Coding) -> DataFrame:
    """(doc_id, ids) of documents, from their pieces encoded one by one."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(coding)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                ids = [coder.encode(text, entry - start, leave - start) for text, start, entry, leave in zip(
                    *(part.column(c).to_pylist() for c in ("text", "start", "entry", "leave")))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc", "doc_id", "chunk")), pa.array(ids, pa.binary())],
                                                 ["doc", "doc_id", "chunk", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind_, rows in groupby(((b.schema.field("doc_id").type, r) for b in batches for r in _rows([b])), lambda r: r[0]):
            for (_, doc_id), parts in groupby((r for _, r in rows), key=lambda r: r[:2]):
                ids = b"".join(r[3] for r in parts)
                yield pa.record_batch([pa.array([doc_id], kind_), pa.array([ids], pa.binary())], ["doc_id", "ids"])

    coded = pieces.mapInArrow(encode, f"doc long, doc_id {kind}, chunk long, ids binary")
    ordered = coded.repartition("doc").sortWithinPartitions("doc", "chunk")
    return ordered.mapInArrow(join, f"doc_id {kind}, ids binary")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit)."""
    coding = Coding(path, pattern)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(coding)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                ids = pa.array([coder.encode(t) for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    short = rows.where(F.char_length("text") <= CHUNK).mapInArrow(encode, f"doc_id {kind}, ids binary")
    long = rows.where(F.char_length("text") > CHUNK).select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")
    # Written before they are spread, so that the numbers of documents are fixed whatever is lost later.
    chunks = stored(_chunks(long), "bpe-cut").repartition("doc", "chunk")
    return short.unionByName(_encoded_pieces(_stitched(chunks, coding), coding))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of `encode_documents` with `decoded`, the bytes of the ids in a row."""
    coding = Coding(path, pattern)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(coding)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = pa.array([coder.decode(ids) for ids in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids binary, decoded binary")
