"""Approximate nearest neighbours by inner product, over robust-pruned directed graphs.

Equal vectors are one node. Nodes are dealt over shards of about `SHARD_ROWS`; each shard's graph is built in one task:
from random edges, every node in turn searches greedily for itself, and robust pruning keeps, nearest first, those
candidates that no kept one is nearer to by the factor alpha; kept edges are also entered backwards. The first pass uses
alpha 1, the second `ALPHA`, which keeps longer and more diverse edges. Vectors get one more coordinate that makes all
norms equal, so the least distance is the largest inner product.

A query is sent to each shard, in blocks of queries, and answered by beam search; scores are recomputed in double
precision on the original vectors, and the best of all shards are merged. Of equal vectors only the least ids can be
answers: as many as are asked for and one more, since a query never answers itself.

Defined cases: null ids, null, zero or empty vectors, vectors with null or non-finite components, and vectors of another
dimension than most take no part; of several rows with one id the least vector counts; fewer candidates than asked for
are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm.common import stored

SHARD_ROWS = 16384
QUERY_ROWS = 2048
DEGREE = 24
BUILD_BEAM, SEARCH_BEAM = 48, 128
ALPHA = 1.2
ENTRIES = 16
#: Nodes that search and are pruned together, and beam entries that are expanded together.
TOGETHER, EXPANDED = 512, 4
#: Parts of a pass after which edges are entered backwards.
ROUNDS = 8


# -- one shard ------------------------------------------------------------------------------------------------------

def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nodes found for each query with the largest inner products, best first (-1 where fewer), and these."""
    n = len(queries)
    first = min(beam, len(entries))
    ids = np.full((n, beam), -1, dtype=np.int32)
    near = np.full((n, beam), -np.inf, dtype=np.float32)
    start = queries @ x[entries].T
    order = np.argsort(-start, axis=1, kind="stable")[:, :first]
    ids[:, :first], near[:, :first] = entries[order], np.take_along_axis(start, order, 1)
    seen = ids < 0
    active = np.arange(n)
    while len(active):
        rows = np.arange(len(active))
        opened = []
        for _ in range(EXPANDED):
            at = np.argmin(seen[active], axis=1)  # the best one not seen, if any
            node = np.where(seen[active, at], -1, ids[active, at])
            seen[active, at] = True
            opened.append(node)
        opened = np.stack(opened, 1)
        new = np.where(opened[:, :, None] >= 0, graph[opened], -1).reshape(len(active), -1)
        # Neighbours already in the beam, or met twice, do not enter again.
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        known = np.zeros((len(active), len(x)), dtype=bool) if len(x) <= 4096 else None
        if known is not None:
            beam_ids = ids[active]
            known[np.repeat(rows, beam)[beam_ids.ravel() >= 0], beam_ids.ravel()[beam_ids.ravel() >= 0]] = True
            new[known[rows[:, None], new]] = -1
        else:
            own = np.sort(ids[active], axis=1)
            offset = (rows * (len(x) + 2))[:, None]
            flat = (own + 1 + offset).ravel()
            place = np.searchsorted(flat, (new + 1 + offset).ravel())
            hit = flat[np.minimum(place, len(flat) - 1)] == (new + 1 + offset).ravel()
            new[hit.reshape(new.shape)] = -1
        close = np.einsum("ard,ad->ar", x[new], queries[active])
        close[new < 0] = -np.inf
        both = np.concatenate([near[active], close], axis=1)
        keep = np.argsort(-both, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], new], axis=1), keep, 1)
        near[active] = np.take_along_axis(both, keep, 1)
        seen[active] = np.take_along_axis(
            np.concatenate([seen[active], np.zeros(new.shape, dtype=bool)], axis=1), keep, 1) | (near[active] == -np.inf)
        active = active[~seen[active].all(axis=1)]
    return ids, near


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of each node chosen among its candidates (-1 for none), nearest first."""
    bad = (candidates < 0) | (candidates == nodes[:, None])
    norm = float(x[0] @ x[0])
    vectors = x[candidates]
    far = np.maximum(norm - np.einsum("bcd,bd->bc", vectors, x[nodes]), 0)  # half the squared distance
    far[bad] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    candidates = np.take_along_axis(candidates, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    apart = np.maximum(norm - np.matmul(vectors, vectors.transpose(0, 2, 1)), 0)
    open_ = np.isfinite(far)
    open_[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        pick = np.argmax(open_, axis=1)
        some = open_[rows, pick]
        if not some.any():
            break
        out[some, k] = candidates[rows[some], pick[some]]
        open_ &= (alpha * alpha * apart[rows, pick] > far) | ~some[:, None]
        open_[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (one row of `degree` per node, -1 for none) and entry nodes, for vectors of equal norm."""
    n = len(x)
    rng = np.random.default_rng(seed)
    degree = min(degree, max(n - 1, 1))
    entries = np.unique(np.append(rng.integers(0, n, ENTRIES), np.argmax(x @ x.mean(0)))).astype(np.int32)
    graph = rng.integers(0, n, (n, degree)).astype(np.int32)
    graph[graph == np.arange(n)[:, None]] = -1
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n).astype(np.int32)
        at_once = max(TOGETHER, -(-n // ROUNDS))
        for at in range(0, n, at_once):
            nodes = order[at:at + at_once]
            chosen = np.full((len(nodes), degree), -1, dtype=np.int32)
            for part in range(0, len(nodes), TOGETHER):
                some = slice(part, part + TOGETHER)
                found, _ = beam_search(x, graph, entries, x[nodes[some]], beam)
                chosen[some] = robust_prune(x, nodes[some], np.concatenate([found, graph[nodes[some]]], axis=1), degree,
                                            alpha)
            graph[nodes] = chosen
            _enter_backwards(x, graph, nodes, alpha)
    return graph, entries


def _enter_backwards(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """Give every target of the nodes' edges an edge back, pruned where there is no room."""
    degree = graph.shape[1]
    ends, starts = graph[nodes].ravel(), np.repeat(nodes, degree)
    starts, ends = starts[ends >= 0], ends[ends >= 0]
    by_end = np.lexsort((-np.einsum("ed,ed->e", x[starts], x[ends]), ends))  # nearest first
    starts, ends = starts[by_end], ends[by_end]
    targets, first, count = np.unique(ends, return_index=True, return_counts=True)
    rank = np.arange(len(ends)) - np.repeat(first, count)
    few = rank < degree
    back = np.full((len(targets), degree), -1, dtype=np.int32)
    back[np.repeat(np.arange(len(targets)), count)[few], rank[few]] = starts[few]
    for part in range(0, len(targets), TOGETHER):
        some = slice(part, part + TOGETHER)
        graph[targets[some]] = robust_prune(
            x, targets[some], np.concatenate([graph[targets[some]], back[some]], axis=1), degree, alpha)


def extended(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with a coordinate that makes every norm `norm`."""
    squares = np.einsum("nd,nd->n", vectors, vectors, dtype=np.float64)
    rest = np.sqrt(np.maximum(norm * norm - squares, 0))
    return np.hstack([vectors, rest[:, None]]).astype(np.float32)


# -- all shards -------------------------------------------------------------------------------------------------------

def _usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def usable_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): one vector per id, all of one dimension."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("vector") == (sizes["size"] if sizes else 0))


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> DataFrame:
    """One stored row per shard of `nodes` (node, vector): shard, ids, vectors, graph, entries, as bytes."""
    rows, norm = nodes.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))).first()
    norm = float(norm or 0.0) ** 0.5
    shards = max(1, -(-rows // shard_rows))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")  # whatever the order of arrival: the same graph
        ids = group.column("node").to_numpy()
        x = np.array(group.column("vector").to_pylist(), dtype=np.float64)
        graph, entries = build_graph(extended(x, norm), degree)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                         "ids": [ids.tobytes()], "vectors": [x.tobytes()], "graph": [graph.tobytes()],
                         "entries": [entries.tobytes()]})

    sharded = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    return stored(sharded.groupBy("shard").applyInArrow(
        build, "shard int, ids binary, vectors binary, graph binary, entries binary"), "graphs")


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM,
                 query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query, node, score): the k best nodes of all shards for each of `queries` (query, vector)."""
    blocks = max(1, -(-queries.count() // query_rows))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    shards = [r["shard"] for r in index.select("shard").distinct().collect()]  # one small number per shard
    asked = asked.withColumn("shard", F.explode(F.array(*map(F.lit, shards)) if shards else F.array().cast("array<int>")))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(graphs: pa.Table, group: pa.Table) -> pa.Table:
        if not graphs.num_rows or not group.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        shard = {c: graphs.column(c)[0].as_py() for c in ("ids", "vectors", "graph", "entries")}
        ids = np.frombuffer(shard["ids"], dtype=np.int64)
        vectors = np.frombuffer(shard["vectors"], dtype=np.float64).reshape(len(ids), -1)
        graph = np.frombuffer(shard["graph"], dtype=np.int32).reshape(len(ids), -1)
        entries = np.frombuffer(shard["entries"], dtype=np.int32)
        names = group.column("query").to_numpy()
        asked_ = np.array(group.column("vector").to_pylist(), dtype=np.float64)
        x = vectors.astype(np.float32)
        out = []
        for at in range(0, len(names), TOGETHER):
            part = asked_[at:at + TOGETHER]
            found, _ = beam_search(x, graph, entries, part.astype(np.float32), max(beam, k))
            score = np.einsum("qbd,qd->qb", vectors[found], part)
            score[found < 0] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            node = np.take_along_axis(found, best, 1)
            has = node >= 0
            out.append((np.repeat(names[at:at + TOGETHER], has.sum(1)), ids[node[has]],
                        np.take_along_axis(score, best, 1)[has]))
        query, node, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query": query, "node": node, "score": score})

    found = spread.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
        search, "query long, node long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank")


def nearest(table: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which `is_query` (over vec_id) holds."""
    rows = stored(usable_vectors(table, id_column, vector), "vectors")
    same = Window.partitionBy("vector").orderBy("vec_id")
    members = rows.select("vec_id", "vector", F.row_number().over(same).alias("_nth"), F.first("vec_id").over(same).alias(
        "node")).where(F.col("_nth") <= k + 1)
    members = stored(members.select("node", "vec_id", F.when(F.col("_nth") == 1, F.col("vector")).alias("vector")), "members")
    nodes = members.where("vector is not null").select("node", "vector")
    asked = rows.where(is_query).groupBy("vector").agg(F.min("vec_id").alias("query"))
    asked = stored(asked, "asked")
    # One more than asked for: the query's own vector may be among them.
    found = search_index(build_index(nodes, shard_rows), asked.select("query", "vector"), k + 1, beam)
    answers = found.join(members.select("node", "vec_id"), "node")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k + 1)
    names = rows.where(is_query).join(asked, "vector").select(F.col("vec_id").alias("query_id"), "query")
    own = names.join(answers.select("query", "vec_id", "score"), "query").where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.select("query_id", F.row_number().over(rank).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
