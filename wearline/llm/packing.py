"""Order-preserving packing of tokenised documents into windows, by dynamic programming.

Documents keep the order in which Spark's partitions hold them. Consecutive documents form runs of about
`RUN_TOKENS` tokens, which are packed on their own, so memory is bounded and no window crosses a run. Inside a run
the candidates for cuts are ends of documents, ends of sentences, and every `STRIDE` tokens inside longer sentences.
The cost of a window is its padding; a cut inside a document adds a penalty, a larger one inside a sentence. Since
padding is window - (j - i), the best predecessor of cut j is the least cost(i) + i among the window's candidates: a
monotone queue gives it in constant time. Windows whose length is a power of two need no padding: these transitions
are looked up exactly.

Defined cases: a null or empty text is the closing id alone; repeated rows and repeated ids are documents of their own;
a null id stays null; any length of text is packed whole; an empty table gives no pieces; other columns are ignored.
Order and numbering follow the input's partitions: with input read from files (or otherwise repeatable) a lost
executor's work is recomputed identically.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import text_or_empty
from wearline.llm.tokens import word_tokenizer

WINDOW = 2048
RUN_TOKENS = 1 << 20
STRIDE = 128
IN_DOCUMENT, IN_SENTENCE = 4.0, 48.0
#: Shortest window that is left unpadded inside a run.
LEAST_EXACT = 256
#: Documents turned into Python strings at once.
TOGETHER = 64
#: Bits of a sequence number that count the sequences of one partition.
PARTITION_BITS = 40

SCHEMA = "doc_id {}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_cuts(at: list[int], penalty: list[float], window: int = WINDOW) -> list[int]:
    """Chosen cut positions, first and last included. `at` ascends from 0, no gap exceeds `window`."""
    total = len(at)
    cost = [0.0] * total
    back = [0] * total
    queue: deque[int] = deque([0])
    exact = [1 << k for k in range(window.bit_length() - 1) if 1 << k >= LEAST_EXACT]
    index = {p: i for i, p in enumerate(at)}
    reach = [0.0] * total  # cost(i) + at(i)
    for j in range(1, total):
        here = at[j]
        while here - at[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        least, by = reach[i] + window - here, i
        for size in exact:
            i = index.get(here - size)
            if i is not None and cost[i] < least:
                least, by = cost[i], i
        least += penalty[j]
        cost[j], back[j] = least, by
        reach[j] = least = least + here
        while queue and reach[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    chosen, j = [at[-1]], total - 1
    while j:
        j = back[j]
        chosen.append(at[j])
    return chosen[::-1]


def _tail(cuts: list[int], window: int) -> list[int]:
    """Part the last window into powers of two if that costs less than its padding."""
    size = cuts[-1] - cuts[-2]
    powers = [1 << k for k in reversed(range(size.bit_length())) if size >> k & 1]
    if size == window or (len(powers) - 1) * IN_SENTENCE >= window - size:
        return cuts
    return cuts[:-1] + [cuts[-2] + sum(powers[:k + 1]) for k in range(len(powers))]


class _Run:
    """Documents gathered until they are packed."""

    def __init__(self):
        self.ids: list[object] = []
        self.parts: list[bytes] = []
        self.starts: list[int] = []
        self.at: list[int] = [0]
        self.penalty: list[float] = [0.0]
        self.tokens = 0

    def add(self, doc_id: object, sentences: list[bytes], closing: bytes) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.tokens)
        here, at, penalty = self.tokens, self.at, self.penalty
        for sentence in sentences:
            size = len(sentence) >> 2
            if size > STRIDE:
                inner = range(here + STRIDE, here + size, STRIDE)
                at.extend(inner)
                penalty.extend([IN_SENTENCE] * len(inner))
            if size:
                here += size
                at.append(here)
                penalty.append(IN_DOCUMENT)
        here += len(closing) >> 2
        at.append(here)
        penalty.append(0.0)
        self.parts.extend(sentences)
        self.parts.append(closing)
        self.tokens = here

    def pieces(self, first: int, window: int, kind: pa.DataType) -> tuple[pa.RecordBatch, int]:
        """One row per piece, and the number of sequences; sequences count from `first`."""
        cuts = np.array(_tail(best_cuts(self.at, self.penalty, window), window))
        content = memoryview(b"".join(self.parts))
        starts = np.array(self.starts)
        begin = np.union1d(cuts[:-1], starts)
        end = np.append(begin[1:], self.tokens)
        doc = np.searchsorted(starts, begin, side="right") - 1
        sequence = np.searchsorted(cuts, begin, side="right") - 1
        lengths = np.diff(np.append(starts, self.tokens))
        batch = pa.record_batch({
            "doc_id": pa.array([self.ids[d] for d in doc], kind), "start": begin - starts[doc],
            "length": end - begin, "doc_tokens": lengths[doc], "sequence_id": first + sequence,
            "offset": begin - cuts[sequence],
            "ids": pa.array([content[4 * b:4 * e] for b, e in zip(begin.tolist(), end.tolist())], pa.binary())})
        return batch, len(cuts) - 1


def pack_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text",
                   window: int = WINDOW, closing_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32 bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        closing = closing_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << PARTITION_BITS
        run, kind = _Run(), None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, TOGETHER):
                for doc_id, content in zip(*(c.to_pylist() for c in batch.slice(at, TOGETHER).columns)):
                    run.add(doc_id, tokenizer.sentences(content), closing)
                    if run.tokens >= RUN_TOKENS:
                        packed, sequences = run.pieces(first, window, kind)
                        yield packed
                        first, run = first + sequences, _Run()
        if run.ids:
            yield run.pieces(first, window, kind)[0]

    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(pack, SCHEMA.format(kind))
