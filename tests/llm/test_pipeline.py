import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from conftest import SF
from test_near_dedup_op import by_force
from test_packing_op import plain
from wearline.llm import queries as llm
from wearline.llm import quality
from wearline.llm.mixing import copies, mix_to_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    accepted = set()
    for r in rows.values():
        raw = r.text.encode()
        form = model.form_features(quality.measures(raw)[None, :], [r.lang], [r.source])
        if model.odds(quality.content(raw)[None, :], form)[2][0] >= model.cut:
            accepted.add(r.doc_id)
    out = docs
    kept = []
    for name, stage in cp.STAGES:
        out.write.parquet(str(tmp_path / name))
        out = stage(spark, spark.read.parquet(str(tmp_path / name)), SF)
        if name != "packing":
            assert out.columns == COLUMNS
            kept.append(Counter(r.doc_id for r in out.select("doc_id").collect()))
    assert kept[0] == Counter(accepted) and len(accepted) < len(rows)
    groups = by_force([(i, rows[i].text) for i in accepted], width=5, percent=80)
    assert kept[1] == Counter(i for i, _, _, stays in groups if stays)
    assert kept[2] == wanted_copies(spark, spark.read.parquet(str(tmp_path / "mixing")), SF)
    assert set(kept[2]) <= set(kept[1]) and max(kept[2].values()) <= 4
    pieces = out.toPandas()
    tokens = sum(n * (len(plain(rows[i].text)) + 1) for i, n in kept[2].items())
    assert pieces["length"].sum() == tokens and Counter(pieces[pieces["start"] == 0]["doc_id"]) == kept[2]
    assert (pieces["ids"].map(len) == 4 * pieces["length"]).all()
    for r in pieces.itertuples():
        part = (plain(rows[r.doc_id].text) + [1])[r.start:r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == part
    assert cp.run(spark, SF).agg({"length": "sum"}).first()[0] == tokens


def wanted_copies(spark, docs, sf_dir):
    """How often each id has to come out of the mixing stage, counted row by row in Python."""
    mixture = mix_to_targets(docs, llm.domains(spark, sf_dir), cp.TARGETS, total=cp.TOTAL, least=cp.LEAST_RATE,
                             most=cp.MOST_RATE, lowered=cp.LOWERED)
    rows = mixture.rows.select("doc_id", "_rate", copies(F.col("_rate"), F.col("doc_id")).alias("n")).collect()
    assert all(r.n in (math.floor(r._rate), math.floor(r._rate) + 1) for r in rows)
    return +Counter({r.doc_id: r.n for r in rows})


def test_a_document_of_rate_zero_goes_and_no_other_is_doubled(spark, tmp_path):
    """30 % toxic documents, which may be lowered, against a target of 10 %."""
    rows = [(i, ("grue snark " if i % 10 < 3 else "") + f"plain words w{i % 17} and more of them {i}", "en", "s", 1)
            for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 10 < 3)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    out = Counter(r.doc_id for r in cp.mixing(spark, docs, str(tmp_path)).collect())
    assert out == wanted_copies(spark, docs, str(tmp_path))
    clean, toxic = ([out[i] for i in range(600) if (i % 10 < 3) == t] for t in (False, True))
    assert min(clean) >= 1 and 0 in toxic and sum(toxic) < 180


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f g", "en", "s", 13),
            (3, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", None, "s", 1),
            (None, "z", "en", "s", 1), (5, "word " * 20_000, "en", "s", 100_000)]
    docs = spark.createDataFrame([(*r, "?") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, node string")
    for name, stage in cp.STAGES:
        kept = stage(spark, docs, SF)
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name == "near_dedup":
            assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 5, None, None])
        elif name == "mixing":
            assert set(kept.columns) == set(docs.columns) and kept.count() >= len(rows)
        else:
            assert kept.count() >= 0
