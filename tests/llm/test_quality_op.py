from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from wearline.llm import quality
from wearline.llm.queries import op7_quality

SF1 = SF.replace("0.001", "0.1")


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    found = quality.score_documents(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    good, bad = found[found["quality"] == 1], found[found["quality"] == 0]
    assert good["accepted"].mean() > 0.99 and bad["accepted"].mean() < 0.1
    for view in ("content_score", "form_score", "quality_score"):
        right = (found[view] > 0.5) == (found["quality"] == 1)
        assert right.mean() > 0.95, view
    for low, high in ((0.0, 0.2), (0.8, 1.0)):  # calibrated: what is called likely is likely
        part = found[(found["quality_score"] >= low) & (found["quality_score"] <= high)]
        assert abs(part["quality"].mean() - part["quality_score"].mean()) < 0.1


def test_whole_table_equals_scores_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    again = quality.train(docs.repartition(7), spark.read.parquet(f"{SF}/labels.parquet"))
    assert np.array_equal(model.content.weights, again.content.weights) and model.cut == again.cut
    rows = {r.doc_id: r for r in docs.collect()}
    found = op7_quality(spark, SF).collect()
    assert len(found) == len(rows) == len({r.doc_id for r in found})
    for r in found:
        raw, d = rows[r.doc_id].text.encode(), rows[r.doc_id]
        form = model.form_features(quality.measures(raw)[None, :], [d.lang], [d.source])
        a, b, both = model.odds(quality.content(raw)[None, :], form)
        assert abs(r.content_score - 1 / (1 + np.exp(-float(a[0])))) < 1e-5
        assert abs(r.quality_score - 1 / (1 + np.exp(-float(both[0])))) < 1e-5
        assert r.accepted == (both[0] >= model.cut) or abs(both[0] - model.cut) < 1e-4


def plain_exchange(content, form, cell):
    """All rows at once, with Python's whole numbers."""
    def hand(models, curves):
        views, out = (content, form), []
        for v in (0, 1):
            slope, offset = curves[1 - v]
            odds = slope * models[1 - v].score(views[1 - v]) + offset
            sums = np.zeros((2, quality.CELLS, views[v].shape[1]), dtype=object)
            counts = np.zeros((2, quality.CELLS), dtype=np.int64)
            for x, o, c in zip(views[v], odds, cell):
                chance = 1 / (1 + np.exp(-float(o)))
                if chance >= quality.SURE or chance <= 1 - quality.SURE:
                    label = int(chance > 0.5)
                    sums[label, c] += [round(float(e) * 2 ** 24) for e in x]
                    counts[label, c] += 1
            out.append(quality.Handed(sums.astype(np.int64), counts))
        return tuple(out)

    return hand


def test_equals_plain_co_training(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, labelled=100)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.withColumn("h", F.xxhash64(F.lit("sample"), "doc_id")).withColumn("c", quality.cell_of("doc_id")).collect()
    taken = sorted((r for r in rows if truth.get(r.doc_id) in (0, 1)), key=lambda r: (r.h, r.doc_id))[:100]
    free = [r for r in rows if r.doc_id not in {t.doc_id for t in taken}]
    known = [[v for v, _ in sorted(Counter(r[k] for r in rows if r[k] is not None).items(), key=lambda e: (-e[1], e[0]))]
             [:quality.VALUES] for k in ("lang", "source")]
    assert len(free) == len(rows) - len(taken) > 0 and model.languages == tuple(known[0]) and model.sources == tuple(known[1])

    def views(some):
        raw = [r.text.encode() for r in some]
        form = np.stack([quality.measures(t) for t in raw])
        return np.stack([quality.content(t) for t in raw]), quality.with_values(
            form, [r.lang for r in some], [r.source for r in some], *known)

    features = {id(r): (quality.content(r.text.encode()).tobytes(), quality.measures(r.text.encode()).tobytes()) for r in taken}
    taken.sort(key=lambda r: (*features[id(r)], truth[r.doc_id]))
    (c_l, f_l), (c_u, f_u) = views(taken), views(free)
    y = np.array([truth[r.doc_id] for r in taken])
    plain = quality.co_train(c_l, f_l, y, plain_exchange(c_u, f_u, [r.c for r in free]), tuple(known[0]),
                             tuple(known[1]), 0.998)
    for a, b in ((model.content, plain.content), (model.form, plain.form)):
        assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
    assert model.curves == plain.curves and model.cut == plain.cut
    alone = quality.train(docs, labels, labelled=100, rounds=0)
    assert not np.array_equal(alone.content.weights, model.content.weights)  # pseudo-labels have an effect


def test_all_unlabelled_rows_are_handed_over(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    many = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    sure = quality.Linear(np.zeros(quality.BUCKETS, dtype=np.float32), 9.0)
    form = quality.Linear(np.zeros(quality.form_width((), ()), dtype=np.float32), -9.0)
    got = []
    for table in (docs, many):
        rows = table.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"),
                            F.col("source").alias("_source"), quality.cell_of("doc_id").alias("_cell"))
        to_content, to_form = quality._exchange(rows, (), ())((sure, form), ((1.0, 0.0), (1.0, 0.0)))
        n = table.count()
        assert to_content.counts.sum(1).tolist() == [n, 0] and to_form.counts.sum(1).tolist() == [0, n]
        got.append(to_form.sums.sum((0, 1)))
    assert np.array_equal(2 * got[0], got[1])


def test_rare_and_null_values_have_features():
    x = quality.with_values(np.zeros((4, quality.MEASURES), dtype=np.float32), ["en", None, "xx", "\ud800"],
                            [None, "s", "s", "t"], ("en",), ("s",))
    assert x.shape[1] == quality.form_width(("en",), ("s",)) and (x.sum(1) == 2).all()
    at = quality.MEASURES
    assert x[0, at] == 1 and x[1, at + 1] == 1 and x[2, at + 2:at + 2 + quality.HASHED].sum() == 1
    assert x[0, at + 2 + quality.HASHED + 1] == 1 and (x[1:3, at + 2 + quality.HASHED] == 1).all()


def test_pseudo_labels_help_a_view_with_few_labels():
    rng = np.random.default_rng(1)

    def view(y, noise, width):
        x = rng.normal(0, noise, (len(y), width)).astype(np.float32)
        x[:, 0] += y * 2 - 1
        return x

    y_l, y_u, y_t = (rng.integers(0, 2, n) for n in (36, 1500, 1500))
    c, f = zip(*((view(y, 1.2, 60), view(y, 0.3, 3)) for y in (y_l, y_u, y_t)))
    exchange = plain_exchange(c[1], f[1], rng.integers(0, quality.CELLS, 1500))
    right = []
    for rounds in (0, 3):
        model = quality.co_train(c[0], f[0], y_l, exchange, (), (), 0.99, rounds)
        right.append(((model.content.score(c[2]) > 0) == y_t).mean())
    assert right[1] > right[0] + 0.03


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "x" * 300_000, "zz", "new"), (3, "x" * 300_000, "zz", "new"),
            (None, "a b c", "en", "s"), (4, "\n\n", "en", None)]
    docs = spark.createDataFrame([(*r, "?", 0) for r in rows],
                                 "doc_id long, text string, lang string, source string, accepted string, _t int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (77, 1), (3, 5)], "doc_id long, quality int")
    assert quality.train(docs, labels) is None
    kept = quality.score_documents(docs, None).collect()
    assert len(kept) == 6 and all(r.accepted is True and r.quality_score == 0.5 for r in kept)
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality.score_documents(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "source", "_t", "content_score", "form_score", "quality_score",
                              "accepted"]
    found = scored.collect()
    assert len(found) == 6 and all(0 <= r.quality_score <= 1 for r in found)
    assert len({r.quality_score for r in found if r.doc_id == 3}) == 1
    assert quality.score_documents(docs.where("false"), model).count() == 0
