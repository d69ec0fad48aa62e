import random
import re
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF
from wearline.llm import near_dedup as nd
from wearline.llm.components import components
from wearline.llm.queries import op8_near_dedup


def shingles(text, width):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def by_force(docs, width=3, percent=85):
    """docs: (id, text); all pairs that share a shingle."""
    sets = [shingles(t, width) for _, t in docs]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    pairs = {(a, b) for at in where.values() for i, b in enumerate(at) for a in at[:i]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if docs[a][0] is not None and docs[b][0] is not None and \
                100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(docs[a][0]), find(docs[b][0])))
            root[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i)
                   for (i, _), s in zip(docs, sets)), key=str)


def check(result, docs, **how):
    assert sorted((tuple(r) for r in result.collect()), key=str) == by_force(docs, **how)


def test_sketch_fills_every_bin_and_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2 ** 63, 3000).astype(np.uint64)
    for size in (1, 2, 7, 130, 2000):
        bins = nd.sketch(np.unique(pool[:size]), 120)
        assert (bins != np.uint64(2 ** 64 - 1)).all()
    for size in (40, 900):
        for share in (0.2, 0.5, 0.85):
            a, b = pool[:size], np.concatenate([pool[:int(size * share)], pool[2000:2000 + size - int(size * share)]])
            exact = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
            equal = np.mean(nd.sketch(np.unique(a), 4000) == nd.sketch(np.unique(b), 4000))
            assert abs(equal - exact) < 0.05


def test_bands_keep_the_stated_recall():
    for similarity in (0.8, 0.85):
        bands = nd.bands_for(similarity)
        assert (1 - similarity ** nd.ROWS) ** bands <= nd.MISS < (1 - similarity ** nd.ROWS) ** (bands - 1)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op8_near_dedup(spark, sf), docs)


def groups(seed):
    """Near copies of one base (linked mostly through it), chains, and texts just under the threshold."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(10_000)}"
    base = [word() for _ in range(200)]
    out = [" ".join(base)]
    for _ in range(60):
        copy = list(base)
        for at in rnd.sample(range(200), rnd.choice([1, 4, 5, 6, 8])):
            copy[at] = word()
        out.append(" ".join(copy))
    chain = list(base[::-1])
    for _ in range(25):
        chain = chain[4:] + [word() for _ in range(4)]
        out.append(" ".join(chain))
    return out + [" ".join(word() for _ in range(50)) for _ in range(20)]


@pytest.mark.parametrize("leaders, block", [(1, 256), (1, 8), (3, 16), (3, 256)])
def test_groups_of_near_copies(spark, monkeypatch, leaders, block):
    monkeypatch.setattr(nd, "LEADERS", leaders)
    monkeypatch.setattr(nd, "BLOCK", block)
    rnd = random.Random(leaders)
    texts = groups(block) + groups(block + 1)
    docs = list(zip(rnd.sample(range(10 ** 6), len(texts)), texts))
    check(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85), docs)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5003}" for i in range(60_000))
    docs = [(9, None), (8, ""), (7, " \t\n"), (5, "One"), (4, "one"), (3, "two words"), (2, "Two words"), (1, "Two\x0bWORDS"),
            (20, long), (21, long + " more"), (None, "a b c d e f g"), (30, "a b c d e f g"), (31, "A b c d e f g"),
            (40, "x y z p q"), (40, "u v w u v w k l"), (41, "x y z p q"), (42, "u v w u v w k l"), (40, "x y z p q"),
            (50, "é a b"), (51, "É a b")]
    frame = spark.createDataFrame([(*d, 0, "?") for d in docs], "doc_id long, text string, node long, bands string")
    check(nd.near_duplicates(frame), docs)


def test_width_five_at_eighty(spark):
    texts = groups(77)
    docs = list(enumerate(texts))
    check(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=5, percent=80), docs,
          width=5, percent=80)


def test_empty_table_and_components(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (102, 103), (200, 200)]
    labels = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in labels} == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)}


def test_all_pairs_at_once_equal_pairs_one_by_one(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 62, 150).astype(np.uint64)
    sets = [np.empty(0, np.uint64), np.unique(base), np.unique(base)]
    for _ in range(80):
        copy, changed = base.copy(), rng.integers(0, 14)
        copy[rng.choice(150, changed, False)] = rng.integers(0, 2 ** 62, changed)
        sets.append(np.unique(copy))
    one_by_one = np.array([[nd.similar(a, b, 85) for b in sets] for a in sets])
    for columns in (7, 8192):
        monkeypatch.setattr(nd, "COLUMNS", columns)
        found = nd.all_similar(sets, 85)
        apart = ~np.eye(len(sets), dtype=bool)
        assert (found[apart] == one_by_one[apart]).all() and found[apart].any() and not found[apart].all()
