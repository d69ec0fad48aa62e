import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from wearline.llm import mixing
from wearline.llm.queries import MIX_TARGETS, domains, op9_mixing

SF01 = SF.replace("0.001", "0.01")


def objective(t, p, x, goal):
    rest = (t * x) @ p - goal
    return float(rest @ np.linalg.pinv((p * t[:, None]).T @ p) @ rest)


def by_force(t, p, goal, least, most):
    """The same least squares problem, by plain projected gradient steps on the whole vector of rates."""
    weight = np.linalg.pinv((p * t[:, None]).T @ p)
    x = np.clip(np.ones(len(t)), least, most)
    for _ in range(4000):
        x = np.clip(x - 0.5 * p @ (weight @ ((t * x) @ p - goal)), least, most)
    return x


def test_whole_table_meets_its_targets(spark):
    rows = op9_mixing(spark, SF01).toPandas()
    names = sorted(MIX_TARGETS)
    assert len(rows) == 1000 and rows["doc_id"].is_unique and (rows["rate"] >= 0).all()
    p, t = rows[[f"p_{d}" for d in names]].to_numpy(), rows["tokens"].to_numpy(float)
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    goal = np.array([MIX_TARGETS[d] for d in names]) * t.sum()
    assert np.allclose((t * rows["rate"]) @ p, goal, atol=2e-3 * t.sum())
    exact = by_force(t, p, goal, 0, np.inf)
    assert abs(objective(t, p, rows["rate"].to_numpy(), goal) - objective(t, p, exact, goal)) < 1e-6 * t.sum()
    assert ((rows["copies"] == np.floor(rows["rate"])) | (rows["copies"] == np.floor(rows["rate"]) + 1)).all()
    assert abs(rows["copies"].mean() - rows["rate"].mean()) < 0.05


def test_held_out_documents_get_their_domain(spark):
    truth = domains(spark, SF01.replace("0.01", "0.1"))
    docs = spark.read.parquet(SF01.replace("0.01", "0.1") + "/documents.parquet").select("doc_id", "text")
    mixture = mixing.mix_to_targets(docs, truth.where("doc_id % 2 = 0"), MIX_TARGETS)
    found = mixture.rows.join(truth.where("doc_id % 2 = 1"), "doc_id").select(
        "domain", F.array_position("_p", F.array_max("_p")).alias("at")).toPandas()
    right = found["domain"] == found["at"].map({k + 1: d for k, d in enumerate(mixture.domains)})
    assert right.mean() > 0.9
    assert right[found["domain"] == "clean"].mean() > 0.97 and right[found["domain"] == "toxic"].mean() > 0.75


@pytest.mark.parametrize("least, most, total", [(0.0, 1.0, 1.0), (1.0, 4.0, 1.3), (0.5, 1.2, 0.9), (0.0, None, 2.0)])
def test_bounds(spark, least, most, total):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    mixture = mixing.mix_to_targets(docs, domains(spark, SF01), {"clean": 0.6, "low": 0.3, "toxic": 0.1}, total=total,
                                    least=least, most=most)
    rows = mixture.rows.select("_tokens", "_p", "_rate").toPandas()
    t, p = rows["_tokens"].to_numpy(float), np.stack(rows["_p"].to_numpy())
    x = rows["_rate"].to_numpy()
    assert (x >= least).all() and (most is None or (x <= most).all())
    goal = np.array([mixture.totals[d][2] for d in mixture.domains])
    exact = by_force(t, p, goal, least, np.inf if most is None else most)
    assert objective(t, p, x, goal) <= objective(t, p, exact, goal) * 1.02 + 1e-6 * t.sum()


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "?", "?"), (2, "", "?", "?"), (None, "a b", "?", "?"), (3, "x " * 50_000, "?", "?"), (3, "x", "?", "?"),
         (3, "x", "?", "?")], "doc_id long, text string, domain string, _labelled string")
    labels = spark.createDataFrame([(3, "a"), (3, "a"), (None, "a"), (1, None), (99, "b"), (2, "other")],
                                   "doc_id long, domain string")
    mixture = mixing.mix_to_targets(docs, labels, {"a": 1, "b": 1})
    rows = mixture.rows.collect()
    assert len(rows) == 6 and all(abs(sum(r["_p"]) - 1) < 1e-9 and r["_rate"] >= 0 for r in rows)
    assert rows[0].domain == "?" and {r["_tokens"] for r in rows} == {0, 1, 2, 50_000}
    none = mixing.mix_to_targets(docs, labels.where("false"), {"a": 3, "b": 1})
    assert all(r["_p"] == [0.5, 0.5] for r in none.rows.collect())
    assert mixing.mix_to_targets(docs.where("false"), labels, {"a": 1}).rows.count() == 0


def test_no_python_in_the_plan(spark):
    plan = op9_mixing(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_domain_above_its_target_is_lowered_and_a_miss_is_reported(spark, caplog):
    docs = spark.createDataFrame([(i, " ".join(["good" if i % 4 else "bad", *(f"w{i * j % 13}" for j in range(20))]))
                                  for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "toxic").otherwise("clean").alias("domain"))
    bounds = {"targets": {"clean": 0.9, "toxic": 0.1}, "total": 1.25, "least": 1.0, "most": 4.0}
    with caplog.at_level("WARNING"):
        stuck = mixing.mix_to_targets(docs, labels, **bounds)
    assert "toxic" in caplog.text and stuck.totals["toxic"][1] > 1.5 * stuck.totals["toxic"][2]
    caplog.clear()
    with caplog.at_level("WARNING"):
        mixture = mixing.mix_to_targets(docs, labels, **bounds, lowered=("toxic",))
    assert not caplog.text
    for _, reached, wanted in mixture.totals.values():
        assert abs(reached - wanted) < 1e-3 * sum(g for _, _, g in mixture.totals.values())
    rates = mixture.rows.select("doc_id", "_rate", "_p").collect()
    clean = mixture.domains.index("clean")
    assert all(r["_rate"] >= r["_p"][clean] - 1e-9 for r in rates) and min(r["_rate"] for r in rates) < 1


def test_words_end_at_signs_and_spaces_of_any_script(spark):
    docs = spark.createDataFrame([(1, "\u201cbad\u201d\u2014word"), (2, "\u00abbad\u00bb\u00a0word"), (3, "\u574f\u8bdd\u3002\u597d\u8bdd\uff0c\u8bdd"),
                                  (4, "caf\u00e9 'x' 12"), (5, "bad word")], "doc_id long, text string")
    rows = {r.doc_id: r for r in mixing._featured(docs, "text", ["doc_id"]).collect()}
    assert [rows[i]._tokens for i in (1, 2, 3, 4)] == [4, 4, 5, 5]
    words = set(mixing._featured(docs.where("doc_id = 5"), "text", ["doc_id"]).first()._buckets[:2])
    assert words <= set(rows[1]._buckets) and words <= set(rows[2]._buckets)


@pytest.mark.parametrize("toxic", [0.5, 0.9, 0.1])
def test_domains_of_any_share_are_told_apart(spark, toxic):
    """Every toxic text has two words that no clean one has, among words that all share."""
    def text(i):
        shared = " ".join(f"w{(i * 31 + j * 7) % 97}" for j in range(30))
        return f"grue {shared} snark" if i % 10 < toxic * 10 else shared

    docs = spark.createDataFrame([(i, text(i)) for i in range(1000)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 < toxic * 10, "toxic").otherwise("clean").alias("domain"))
    mixture = mixing.mix_to_targets(docs, labels.where("doc_id % 3 = 0"), {"clean": 0.9, "toxic": 0.1})
    found = mixture.rows.join(labels, "doc_id").where("doc_id % 3 <> 0").toPandas()
    best = found["_p"].map(np.argmax).map(dict(enumerate(mixture.domains)))
    assert (best == found["domain"]).mean() > 0.95
    wanted = {d: g for d, (_, _, g) in mixture.totals.items()}
    share = found.assign(taken=found["_tokens"] * found["_rate"]).groupby("domain")["taken"].sum()
    assert abs(share["toxic"] / share.sum() - 0.1) < 0.02 and abs(wanted["toxic"] / sum(wanted.values()) - 0.1) < 1e-9


def test_a_descent_that_does_not_settle_fails(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    docs = spark.createDataFrame([(i, "good " * 3 if i % 2 else "bad " * 5) for i in range(100)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "toxic").otherwise("clean").alias("domain"))
    with pytest.raises(RuntimeError, match="settle"):
        mixing.mix_to_targets(docs, labels, {"clean": 0.8, "toxic": 0.2}, least=0.3, most=1.2)
