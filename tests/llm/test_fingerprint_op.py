import hashlib
from collections import Counter

import numpy as np
import pytest

from conftest import SF
from wearline.llm import fingerprints as fp
from wearline.llm.queries import op2_fingerprints


def jaccard(a, b):
    words = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in words) / max(sum(max(a[w], b[w]) for w in words), 1)


def test_collision_rate_is_the_generalised_jaccard_similarity():
    sketcher = fp.Sketcher(4096)
    base = Counter({f"w{i}": 1 + i % 5 for i in range(60)})
    for step in (0, 10, 25, 50, 60):
        other = Counter({f"w{i}": 1 + (i * (1 + (step > 20))) % 5 for i in range(step, 60 + step)})
        a, b = sketcher.signatures([base, other])
        assert abs(fp.likeness(a, b) - jaccard(base, other)) < 0.035


def test_memory_of_samples_does_not_change_results(monkeypatch):
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(i)) for i in range(1, 60)]
    wide = fp.Sketcher().signatures([fp.weights(t) for t in texts])
    monkeypatch.setattr(fp, "REMEMBERED", 40)
    narrow = fp.Sketcher()
    for t, mark in zip(texts, wide):
        assert (narrow.signatures([fp.weights(t)])[0] == mark).all()


def test_samples_used_most_stay(monkeypatch):
    monkeypatch.setattr(fp, "REMEMBERED", 100)
    drawn, real = Counter(), fp.samples

    def counted(terms, *more):
        drawn.update(w for w, _ in terms)
        return real(terms, *more)

    monkeypatch.setattr(fp, "samples", counted)
    sketcher = fp.Sketcher()
    for i in range(200):
        sketcher.signatures([fp.weights(" ".join(["often", "twice twice", *(f"w{i}x{j}" for j in range(20))]))])
    assert set(drawn.values()) == {1}


def test_words_of_latin_texts_are_those_of_the_pattern():
    texts = ["".join(map(chr, range(256))), *(f"Aß{chr(c)}b {chr(c)}É_9" for c in range(0x250)), "x\u0130Y \u03a3"]
    for text in texts:
        assert list(fp.weights(text).items()) == list(Counter(fp._WORDS.findall(text.lower())).items())


def check(docs, found):
    """docs: (id, text) with unique ids, in any order."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0]), reverse=True)
    rows = {r["doc_id"]: r for r in found}
    assert len(found) == len(docs) == len(rows)
    marks = fp.Sketcher().signatures([fp.weights(t or "") for _, t in order])
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        r = rows[doc_id]
        mark = fp.Sketcher().signatures([fp.weights(edited)])[0]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.written(marks[k]) and r["edited_fingerprint"] == fp.written(mark)
        assert r["near_edited"] == fp.likeness(marks[k], mark)
        assert r["near_next"] == fp.likeness(marks[k], marks[(k + 1) % len(order)])


@pytest.mark.parametrize("block", [7, 2048])
def test_whole_table(spark, monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK_ROWS", block)
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    found = op2_fingerprints(spark, SF).collect()
    check(list(zip(docs["doc_id"], docs["text"])), found)
    assert np.mean([r["near_edited"] for r in found]) > 0.4 > 0.15 > np.mean([r["near_next"] for r in found])


@pytest.mark.parametrize("heads", [0, fp.BROADCAST_HEADS])
def test_odd_texts_and_ids(spark, monkeypatch, tmp_path, heads):
    monkeypatch.setattr(fp, "BLOCK_ROWS", 2)
    monkeypatch.setattr(fp, "BROADCAST_HEADS", heads)
    docs = [(-5, None), (0, ""), (1, "!!!"), (2 ** 60, "a b c d e f"), (2 ** 60 + 1, "é" * 5), (7, "word " * 40_000),
            (None, "null id of some words"), (8, "A b"), (9, "a B")]
    spark.createDataFrame([(*d, "?", True) for d in docs], "doc_id long, text string, fingerprint string, _borrowed boolean"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    check(docs, op2_fingerprints(spark, str(tmp_path)).collect())


def test_repeats_single_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.neighbour_fingerprints(empty).count() == 0 and fp.fingerprint_documents(empty).count() == 0
    single = fp.neighbour_fingerprints(spark.createDataFrame([(4, "one two three")], "doc_id long, text string")).first()
    assert single.near_next == 1.0
    twice = fp.neighbour_fingerprints(spark.createDataFrame([(4, "a b c"), (4, "a b c"), (3, None)],
                                                            "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice if r.doc_id == 4}) == 1


def test_blocks_are_even_for_any_ids(spark):
    rng = np.random.default_rng(3)
    far = [*range(20_000), 10 ** 15]
    wide = [int(i) for i in rng.integers(-2 ** 63, 2 ** 63 - 1, 20_000)] + [-2 ** 63, 2 ** 63 - 1]
    for ids in (far, wide):
        docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
        blocks = fp._blocks(docs).groupBy("_block").count().collect()
        assert sum(b["count"] for b in blocks) == len(ids) + len(blocks)
        assert max(b["count"] for b in blocks) <= fp.BLOCK_ROWS + 1


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_order_of_random_ids(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(fp, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    ids = [int(i) for i in rng.integers(-2 ** 63, 2 ** 63 - 1, 40)] + [-2 ** 63, 2 ** 63 - 1, None]
    docs = [(i, f"w{k} w{k % 3} of words") for k, i in enumerate(ids)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(docs, op2_fingerprints(spark, str(tmp_path)).collect())
