"""Chat formatting by token-level assembly.

A turn is written as BEGIN role SAYS text END. Role and text are encoded on their own, as ordinary text, and the three
marks are spliced in as reserved ids beyond the vocabulary; no content can produce them. The loss mask of a turn is the
prefix sum of +1 where a trained segment begins and -1 where it ends. Where a turn starts in its conversation is the
prefix sum of the lengths before it, counted per block of turns first, so a huge conversation is spread over tasks.

In the readable form the marks are strings. Inside content a backslash is doubled and each mark's string gets a backslash
behind its first character; then no mark's string remains in content, and dropping one backslash of each pair or
single one restores the content.

Defined cases: null role or text are empty; turns are ordered by turn (nulls first), then role, then text, repeats stay;
null conversation ids are one conversation; texts of any length are encoded whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm.common import text_or_empty

BEGIN, SAYS, END = "<turn>", "<says>", "</turn>"
MARKS = (BEGIN, SAYS, END)
#: The vocabulary's ids end before this one; marks take the ids from here on, in the order of MARKS.
FIRST_RESERVED = 50257
#: Turns of a conversation that one block counts.
BLOCK_TURNS = 512


def escape(content: str) -> str:
    content = content.replace("\\", "\\\\")
    for mark in MARKS:
        content = content.replace(mark, f"{mark[0]}\\{mark[1:]}")
    return content


def unescape(content: str) -> str:
    return re.sub(r"\\(.)", r"\1", content, flags=re.S)


class ChatTokenizer:
    """Byte-level ids of ordinary text, and back."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, content: str) -> list[int]:
        return self._coder.encode_ordinary(content)

    def decode(self, ids: list[int]) -> str:
        return self._coder.decode_bytes(ids).decode("utf-8")


_loaded: dict[tuple[str, str], ChatTokenizer] = {}


def chat_tokenizer(ranks_path: str, pattern: str) -> ChatTokenizer:
    if (ranks_path, pattern) not in _loaded:
        _loaded[ranks_path, pattern] = ChatTokenizer(ranks_path, pattern)
    return _loaded[ranks_path, pattern]


def assemble(tokenizer: ChatTokenizer, role: str, text: str, trained: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    begin, says, end = range(FIRST_RESERVED, FIRST_RESERVED + 3)
    head, body = tokenizer.encode(escape(role)), tokenizer.encode(escape(text))
    ids = np.array([begin, *head, says, *body, end], dtype=np.int32)
    steps = np.zeros(len(ids) + 1, dtype=np.int64)
    if trained:
        steps[len(head) + 2] += 1
        steps[len(head) + 2 + len(body)] -= 1
    return ids, np.cumsum(steps)[:-1].astype(bool)


def read_turn(tokenizer: ChatTokenizer, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, str]:
    """Role, text, text under the mask, and the readable form, from ids and mask alone."""
    marks = np.flatnonzero(ids >= FIRST_RESERVED)
    if ids[marks].tolist() != [FIRST_RESERVED, FIRST_RESERVED + 1, FIRST_RESERVED + 2] or marks[-1] != len(ids) - 1:
        raise ValueError("not a turn")
    head = tokenizer.decode(ids[1:marks[1]].tolist())
    body = tokenizer.decode(ids[marks[1] + 1:-1].tolist())
    under = tokenizer.decode(ids[loss].tolist())
    return unescape(head), unescape(body), unescape(under), BEGIN + head + SAYS + body + END


def format_conversations(turns: DataFrame, ranks_path: str, pattern: str, conversation: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text",
                         trained_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, turn, start (its conversation's ids before it), ids (array), loss (array)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(ranks_path, pattern)
        for batch in batches:
            done = [assemble(tokenizer, r, t, r == trained_role)
                    for r, t in zip(batch.column("_role").to_pylist(), batch.column("_text").to_pylist())]
            ends = np.cumsum([0, *(len(ids) for ids, _ in done)]).astype(np.int32)
            flat = np.concatenate([ids for ids, _ in done]) if done else np.zeros(0, np.int32)
            mask = np.concatenate([loss for _, loss in done]) if done else np.zeros(0, bool)
            yield pa.record_batch(
                [*(batch.column(c) for c in ("conv_id", "turn", "_tie")),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(mask))], ["conv_id", "turn", "_tie", "ids", "loss"])

    rows = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        text_or_empty(role).alias("_role"), text_or_empty(text).alias("_text"))
    # Rows of one turn number keep a fixed order without carrying their text along.
    rows = rows.withColumn("_tie", F.concat_ws(" ", "_role", F.sha2("_text", 256)))
    kind = rows.schema["conv_id"].dataType.simpleString()
    coded = rows.mapInArrow(encode, f"conv_id {kind}, turn long, _tie string, ids array<int>, loss array<boolean>")
    coded = coded.withColumn("_block", F.coalesce(F.expr(f"(turn - pmod(turn, {BLOCK_TURNS})) div {BLOCK_TURNS}"),
                                                  F.lit(-(2 ** 62))))
    coded = coded.withColumn("_size", F.size("ids").cast("long"))
    blocks = coded.groupBy("conv_id", "_block").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_of"),
                           F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("conv_id", "_block").orderBy(F.col("turn").asc_nulls_first(), "_tie").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = coded.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    placed = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_of")))
    return placed.select("conv_id", "turn", (F.col("_offset") + F.col("_before")).alias("start"), "ids", "loss")


def read_back(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest over a whole conversation is sequential by nature: its turns pass through one task in order, but are
    never held there.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(ranks_path, pattern)
        now, started = None, False
        done: list[tuple] = []

        def fresh() -> tuple:
            return [0, 0, 0], hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            done.append((now, counts[0], all_.hexdigest(), counts[1], trained.hexdigest(), counts[2]))

        counts, all_, trained = fresh()
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            conv, ids, loss = (batch.column(c) for c in ("conv_id", "ids", "loss"))
            for k, c in enumerate(conv.to_pylist()):
                if not started or c != now:
                    if started:
                        close()
                    now, started = c, True
                    counts, all_, trained = fresh()
                role, text, under, readable = read_turn(
                    tokenizer, ids[k].values.to_numpy(), loss[k].values.to_numpy(zero_copy_only=False))
                all_.update(f"{role}\n{text}\n".encode())
                trained.update(under.encode())
                for i, n in enumerate((1, len(under), len(readable))):
                    counts[i] += n
            if len(done) >= 10_000:
                yield _digests(done, kind)
                done = []
        if started:
            close()
            yield _digests(done, kind)

    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, " \
             "loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(digest, schema)


def _digests(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*done))
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))
