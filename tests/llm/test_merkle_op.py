import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from conftest import SF
from wearline.llm import merkle, queries, sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, leaf string, _group int, root string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def lowered(doc_id, text):
    if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 5:
        return text
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes, fanout):
    """The root, and per node the (before, after) texts up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k // fanout * fanout
            paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1:first + fanout])))
            at[i] = k // fanout
        nodes = [h("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def by_force(rows, fanout=16):
    """rows: (doc_id, text, lang, source, n_chars) -> sorted result rows of the query."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        changed = plain_leaf(doc_id, source, lang, n_chars, lowered(doc_id, text))
        groups[source].append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        groups[source].sort(key=lambda r: r[:4])
        trees.append(tree([r[2] for r in groups[source]], fanout))
    if not trees:
        return []
    root, upper = tree([t[0] for t in trees], fanout)
    out = []
    for source, (subroot, paths), above in zip(order, trees, upper):
        for (_, _, leaf, changed, doc_id), path in zip(groups[source], paths):
            node = changed
            for before, after in path + above:
                node = h(before + node + after)
            out.append((doc_id, leaf, subroot, root, h("".join(b + a for b, a in path + above)), node, node == root))
    return sorted(out, key=str)


def result(spark, monkeypatch, docs):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    return sorted((tuple(r) for r in queries.op13_merkle(spark, "").select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


def test_query_equals_its_sql(spark):
    assert difference(queries.op13_merkle(spark, SF), connect(SF), sql.statements()["op13_merkle"]) == ""


def test_odd_rows_against_brute_force(spark, monkeypatch):
    rows = [(i * 7919 - 40_000, f"Text {i} ÄÖ Ab" * (i % 5), "en", "hot", i) for i in range(300)]
    rows += [(i, "ONE", None, f"s{i:02}", None) for i in range(40)]
    rows += [(1, None, "de", None, 0), (None, "NULL id", "de", None, 1), (None, None, None, None, None),
             (5, "", "", "", 0), (5, "", "", "", 0), (6, "again", "en", "twice", 1), (6, "other", "en", "twice", 1),
             (-2 ** 63, "least", "en", "ends", -1), (2 ** 63 - 1, "MOST", "en", "ends", 2 ** 31 - 1),
             (8, "Ü😀 " * 40_000 + "LONG", "en", "é", 9), (9, "K", "en", "Ωmega", 1)]
    want = by_force(rows)
    got = result(spark, monkeypatch, frame(spark, rows).repartition(7))
    assert got == want
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2
    again = result(spark, monkeypatch, frame(spark, rows[::-1]).repartition(3))
    assert again == got


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257])
def test_sizes_about_the_fanout(spark, monkeypatch, n):
    rows = [(i, f"T{i}", "en", "only", i) for i in range(n)]
    assert result(spark, monkeypatch, frame(spark, rows)) == by_force(rows)


def test_empty_table(spark, monkeypatch):
    assert result(spark, monkeypatch, frame(spark, [])) == []


def test_any_change_is_noticed_and_a_foreign_path_is_refused(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(50)]
    docs = frame(spark, rows)
    manifest = merkle.merkle_manifest(docs, altered={"n_chars": F.col("n_chars") + 1}, fanout=4)
    folded = manifest.select((merkle.fold(F.col("altered_leaf"), F.col("path")) == F.col("root")).alias("bad"),
                             (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("good"))
    assert folded.where("good and not bad").count() == 50
    paths = {r.doc_id: r.path for r in manifest.collect()}
    assert len({str(p) for p in paths.values()}) == 50
    with pytest.raises(ValueError):
        merkle.merkle_manifest(docs, fanout=6)


def test_checksum_in_sql():
    texts = ["0", "41", "-7", "9223372036854775807"]
    got = [duckdb.sql(f"SELECT {sql.crc32(repr(t))}").fetchall()[0][0] for t in texts]
    assert got == [zlib.crc32(t.encode()) for t in texts]
