"""URL filters: rules and block lists as Bloom filter cascades.

A cascade answers membership exactly for every key of a known universe. Level 0 is a Bloom filter of the listed keys,
level 1 one of the universe's unlisted keys that level 0 lets through, level 2 one of the listed keys that level 1 lets
through, and so on until a level lets nothing false through. The universe is every key the corpus can ask for, so the
answer is exact for the corpus, at a few bits per listed key and without a join.

Keys are told apart by two 64-bit hashes. They are spread over shards by hash, each shard has its own cascade of bounded
size, built in one task. `contains` sends the cascades to all tasks if they are small (the size is known, since they are
built first); otherwise it streams pages and cascades of a shard together, a shard's pages over many tasks.

Defined cases: a null url, or one without "://", has an empty host and path; an empty list gives a cascade that
contains nothing; repeated keys count once; urls of any length are read whole; an empty table gives no rows; columns of
the pages other than the url are kept, clashing ones excepted (see `judge_urls`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import stored

#: Distinct keys of a shard, on average.
SHARD_KEYS = 1 << 20
#: Cascades up to this size go to every task.
BROADCAST_BYTES = 64 << 20
#: Tasks that share a shard's rows when cascades are streamed.
SALTS = 32
_CASCADE = "shard int, level int, hashes int, size long, bits binary"


class Rule(NamedTuple):
    action: str  # "allow" or "block"
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first "://" up to a slash, question mark, number sign or the end; A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


# -- filters ------------------------------------------------------------------------------------------------------

class Level(NamedTuple):
    hashes: int
    size: int
    bits: np.ndarray


def _places(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, size: int) -> Iterator[np.ndarray]:
    """Bit positions of keys, one hash function after the other."""
    turn = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    a = h1.view(np.uint64) ^ turn
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    b = (h2.view(np.uint64) + turn) | np.uint64(1)
    b = (b ^ (b >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    for k in range(hashes):
        x = a + np.uint64(k) * b
        x ^= x >> np.uint64(32)
        yield (x % np.uint64(size)).astype(np.int64)


def _passes(level: Level, at: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    passed = np.ones(len(h1), dtype=bool)
    for place in _places(h1, h2, at, level.hashes, level.size):
        passed &= (level.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return passed


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[Level]:
    """Levels for distinct keys, given which of them are listed."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[Level] = []
    while len(inside):
        # The first level lets about as many through as are listed, the others half.
        rate = min(0.5, len(inside) / (len(outside) + 1)) if not levels else 0.5
        hashes = max(1, round(-np.log2(rate)))
        size = int(len(inside) * hashes * 1.4427) + 64
        bits = np.zeros(size + 7 >> 3, dtype=np.uint8)
        for place in _places(h1[inside], h2[inside], len(levels), hashes, size):
            np.bitwise_or.at(bits, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        level = Level(hashes, size, bits)
        false = outside[_passes(level, len(levels), h1[outside], h2[outside])]
        levels.append(level)
        inside, outside = false, inside
    return levels


def member(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    answer = np.zeros(len(h1), dtype=bool)
    open_ = np.arange(len(h1))
    for at, level in enumerate(levels):
        open_ = open_[_passes(level, at, h1[open_], h2[open_])]
        answer[open_] = at % 2 == 0  # so far: let through by an even level, that is listed
    return answer


# -- cascades in Spark ----------------------------------------------------------------------------------------------

def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


class Cascade(NamedTuple):
    """`table`: levels of all shards (shard, level, hashes, size, bits), stored; `total`: bytes of all levels."""
    table: DataFrame
    shards: int
    total: int


def build_cascade(listed: DataFrame, universe: DataFrame, label: str = "cascade") -> Cascade:
    """The cascade of the first column of `listed` over the first columns of both frames; null keys are left out."""
    def hashed(keys: DataFrame, flag: bool) -> DataFrame:
        key = F.col(keys.columns[0])
        h1, h2 = _hashes(key)
        return keys.where(key.isNotNull()).select(h1.alias("h1"), h2.alias("h2"), F.lit(flag).alias("listed"))

    keys = hashed(universe, False).unionByName(hashed(listed, True))
    keys = stored(keys.groupBy("h1", "h2").agg(F.max("listed").alias("listed")), f"{label}-keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def build(group: pa.Table) -> pa.Table:
        h1, h2 = (group.column(c).to_numpy() for c in ("h1", "h2"))
        levels = build_levels(h1, h2, group.column("listed").to_numpy())
        n = len(levels)
        return pa.table({
            "shard": pa.array([group.column("shard")[0].as_py()] * n, pa.int32()), "level": pa.array(range(n), pa.int32()),
            "hashes": pa.array([x.hashes for x in levels], pa.int32()), "size": pa.array([x.size for x in levels], pa.int64()),
            "bits": pa.array([x.bits.tobytes() for x in levels], pa.binary())})

    sharded = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    table = stored(sharded.groupBy("shard").applyInArrow(build, _CASCADE), label)
    total = table.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    return Cascade(table, shards, total)


def _levels(rows: list) -> dict[int, list[Level]]:
    """Levels of each shard, from rows in any order."""
    of: dict[int, list[Level]] = {}
    for shard, _, hashes, size, bits in sorted(rows, key=lambda r: (r[0], r[1])):
        of.setdefault(shard, []).append(Level(hashes, size, np.frombuffer(bits, dtype=np.uint8)))
    return of


class Question(NamedTuple):
    """Whether the key in column `key` is in `cascade`; the answer goes to column `answer`."""
    key: str
    cascade: Cascade
    answer: str


def contains(rows: DataFrame, questions: list[Question], most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with a boolean column for each question (null keys are in no list)."""
    if sum(q.cascade.total for q in questions) <= most_bytes:
        return _contains_sent(rows, questions)
    for question in questions:
        rows = _contains_streamed(rows, question)
    return rows


def _schema(rows: DataFrame, answers: list[str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields),
                      *(f"`{a}` boolean" for a in answers)])


def _answer(h1: pa.Array, h2: pa.Array, of: dict[int, list[Level]], shards: int) -> np.ndarray:
    a, b = (h.to_numpy(zero_copy_only=False) for h in (h1, h2))
    found = np.zeros(len(a), dtype=bool)
    shard = a % shards  # of the sign of the divisor, as in pmod
    for s in np.unique(shard).tolist():
        if s in of:
            here = np.flatnonzero(shard == s)
            found[here] = member(of[s], a[here], b[here])
    return found


def _contains_sent(rows: DataFrame, questions: list[Question]) -> DataFrame:
    """All cascades in every task; `contains` has checked their size."""
    session, fields = rows.sparkSession, rows.columns
    tables = {id(q.cascade): _levels([tuple(r) for r in q.cascade.table.collect()]) for q in questions}
    sent = session.sparkContext.broadcast([(tables[id(q.cascade)], q.cascade.shards) for q in questions])
    answers = [q.answer for q in questions]
    for n, q in enumerate(questions):
        h1, h2 = _hashes(F.col(q.key))
        rows = rows.withColumns({f"_a{n}": h1, f"_b{n}": h2, f"_known{n}": F.col(q.key).isNotNull()})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n, (of, shards) in enumerate(sent.value):
                known = batch.column(f"_known{n}").to_numpy(zero_copy_only=False)
                found.append(pa.array(known & _answer(batch.column(f"_a{n}"), batch.column(f"_b{n}"), of, shards)))
            yield pa.record_batch([*(batch.column(c) for c in fields), *found], [*fields, *answers])

    return rows.mapInArrow(probe, _schema(rows.select(*fields), answers))


def _contains_streamed(rows: DataFrame, question: Question) -> DataFrame:
    """Cascades too large to send: a shard's levels come first in each of its salted streams, and rows follow."""
    fields, answer, shards = rows.columns, question.answer, question.cascade.shards
    h1, h2 = _hashes(F.col(question.key))
    salted = rows.withColumns({
        "_a": h1, "_b": h2, "_known": F.col(question.key).isNotNull(), "_shard": F.pmod(h1, F.lit(shards)).cast("int"),
        "_salt": F.pmod(F.xxhash64(*fields), F.lit(SALTS)).cast("int")})
    levels = question.cascade.table.select(
        F.col("shard").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
        *(F.col(c).alias(f"_{c}") for c in ("level", "hashes", "size", "bits")))
    both = salted.unionByName(levels, allowMissingColumns=True)
    both = both.repartition("_shard", "_salt").sortWithinPartitions(
        "_shard", "_salt", F.col("_level").asc_nulls_last())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of = None, {}
        for batch in batches:
            shard, salt = (batch.column(c).to_numpy() for c in ("_shard", "_salt"))
            is_level = batch.column("_level").is_valid().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | np.diff(is_level)) + 1
            for start, end in zip([0, *turns], [*turns, batch.num_rows]):
                part, here = batch.slice(start, end - start), (int(shard[start]), int(salt[start]))
                if here != now:
                    now, of = here, {here[0]: []}
                if is_level[start]:
                    for k, n, bits in zip(*(part.column(c).to_pylist() for c in ("_hashes", "_size", "_bits"))):
                        of[here[0]].append(Level(k, n, np.frombuffer(bits, dtype=np.uint8)))
                else:
                    known = part.column("_known").to_numpy(zero_copy_only=False)
                    found = known & _answer(part.column("_a"), part.column("_b"), of, shards)
                    yield pa.record_batch([*(part.column(c) for c in fields), pa.array(found)], [*fields, answer])

    return both.mapInArrow(merge, _schema(rows, [answer]))


# -- rules ------------------------------------------------------------------------------------------------------------

def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Every key under which a rule of the list could stand, longest first; a rule's key is its host and path.

    Rules have few different numbers of host labels and lengths of paths; only these are asked for.
    """
    shapes = {(r.host.count(".") + 1, len(r.path)) for r in rules}
    labels = F.split(host, r"\.")
    keys = []
    for count, length in sorted(shapes):
        suffix = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - count + 1, F.lit(1)), count))
        fits = (F.size(labels) >= count) & (F.char_length(path) >= length)
        keys.append(F.when(fits, F.concat(suffix, F.substring(path, 1, length))))
    keys = F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")
    return F.array_sort(keys, lambda a, b: F.char_length(b) - F.char_length(a))


def judge_urls(pages: DataFrame, rules: list[Rule], blocked_hosts: DataFrame, url: str = "url",
               id_column: str = "page_id", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: id, host, path, rule (key of the longest fitting one, else null), verdict.

    A rule fits its host and all subdomains where the path starts with the rule's path. Without a fitting rule the
    verdict is "block" if the host is in `blocked_hosts` (its first column), else "allow". Allowing rules, blocking
    rules and blocked hosts are one cascade each, over all keys that the pages can ask for.
    """
    if any(r.action not in ("allow", "block") for r in rules):
        raise ValueError("the action of a rule is allow or block")
    spark = pages.sparkSession
    asked = pages.select(F.col(id_column), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    asked = asked.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = asked.select(F.explode("_keys").alias("key")).distinct()
    hosts = asked.select("host").distinct()

    def listed(action: str) -> DataFrame:
        return spark.createDataFrame([(r.host + r.path,) for r in rules if r.action == action], "key string")

    cascades = {a: build_cascade(listed(a), universe, f"url-{a}") for a in ("allow", "block")}
    # Candidates stand side by side, longest first: pages are never multiplied by them.
    places = range(len({(r.host.count("."), len(r.path)) for r in rules}))
    judged = asked.select("*", *(F.get("_keys", F.lit(p)).alias(f"_key{p}") for p in places)).drop("_keys")
    questions = [Question(f"_key{p}", cascade, f"_{action}{p}") for p in places for action, cascade in cascades.items()]
    questions.append(Question("host", build_cascade(blocked_hosts, hosts, "url-hosts"), "_listed"))
    judged = contains(judged, questions, most_bytes)
    rule = F.coalesce(F.lit(None).cast("string"), *(F.when(F.col(f"_allow{p}") | F.col(f"_block{p}"), F.col(f"_key{p}"))
                                                    for p in places))
    verdict = F.coalesce(F.lit(None).cast("string"), *(F.when(F.col(f"_allow{p}"), "allow").when(
        F.col(f"_block{p}"), "block") for p in places), F.when(F.col("_listed"), "block").otherwise("allow"))
    return judged.select(id_column, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
