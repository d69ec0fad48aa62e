from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from wearline.llm import neighbours as nb
from wearline.llm.queries import op5_neighbours


def exact(rows, k, every):
    """rows: (id, vector); for each query the scores of the k best others, and every candidate's score."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[ids[q]] = [(int(ids[i]), score[i]) for i in order]
    return out


def recall(found, rows, k, every):
    best = exact(rows, k, every)
    by_query = defaultdict(list)
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query[r.query_id].append(r)
    assert set(by_query) == {q for q, b in best.items() if b}
    hits = total = 0
    for q, answers in by_query.items():
        assert [a.rank for a in answers] == list(range(1, len(answers) + 1))
        assert len(answers) == min(k, len(rows) - 1) and len({a.vec_id for a in answers}) == len(answers)
        assert all(a.vec_id != q and abs(a.score - vectors[q] @ vectors[a.vec_id]) < 1e-12 for a in answers)
        keys = [(-a.score, a.vec_id) for a in answers]
        assert keys == sorted(keys)
        hits += len({a.vec_id for a in answers} & {i for i, _ in best[q]})
        total += len(best[q])
    return hits / total


@pytest.mark.parametrize("shard_rows", [100, nb.SHARD_ROWS])
def test_whole_table(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(nb, "SHARD_ROWS", shard_rows)
    sf = SF.replace("0.001", "0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = (op5_neighbours(spark, sf) if shard_rows == nb.SHARD_ROWS else nb.nearest(
        spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20, shard_rows=shard_rows)).collect()
    assert recall(found, rows, 20, 20) > 0.95


def test_norms_that_differ_and_one_vector_a_third_of_all(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 1, (900, 12)) * rng.lognormal(0, 0.7, (900, 1))
    vectors[::3] = vectors[0]
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame([(*r, "?", 1) for r in rows], "vec_id long, embedding array<float>, node string, rank int")
    found = nb.nearest(table, F.col("vec_id") % 5 == 0, 7).collect()
    assert recall(found, rows, 7, 5) > 0.95


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    x = nb.extended(np.array([[0, 0], [1, 0], [2, 0], [0, 1.5], [0, 0]], dtype=np.float64), 4.0)
    edges = nb.robust_prune(x, np.array([0]), np.array([[3, 2, 1, -1, 0, 1]]), 3, 1.0)
    assert edges[0].tolist() == [1, 3, -1]  # 2 is nearer to 1 than to 0
    assert set(nb.robust_prune(x, np.array([0]), np.array([[3, 2, 1]]), 3, 3.0)[0].tolist()) == {1, 2, 3}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (10, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = nb.nearest(table, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, 1, 10, 1.0), (0, 2, 1, 0.5), (0, 3, 9, -1.0)]
    assert nb.nearest(table.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert nb.nearest(table.where("vec_id = 0"), F.col("vec_id") % 20 == 0, 20).count() == 0
