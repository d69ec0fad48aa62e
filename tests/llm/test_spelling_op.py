import random
import re
import zlib
from collections import Counter

import pytest

from checks.compare import connect, difference
from conftest import SF
from wearline.llm import queries, spelling, sql

SCHEMA = "doc_id long, text string, word string, n int, key string"


def one_edit(x, y):
    """Exactly one inserted, deleted or replaced code point."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            if len(low) >= 7:
                counts[low] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def by_force(rows):
    words = counted(rows)
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()),
                  key=str)


def result(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(*r, "word", 3, "key") for r in rows], SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *_: docs.repartition(3))
    got = queries.op12_spelling(spark, "").select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_query_equals_its_sql(spark):
    assert difference(queries.op12_spelling(spark, SF), connect(SF), sql.statements()["op12_spelling"]) == ""


def test_odd_rows_against_brute_force(spark, monkeypatch):
    chain = [("wonderful ", 3000), ("wonderfull ", 300), ("wonderfulll ", 30), ("wonderfullll ", 3), ("wonderfulé ", 2)]
    rows = [(1, None), (2, ""), (None, "nothing nothing nothingg NOTHING"), (None, "nothing"), (3, "short word"),
            (4, "ÄÖÜäöünä ÄÖÜäöünä łodkaaaaaa äbcdefgh äbcdefgh äbcdefghi× äbcdefghi×"),
            (5, "longest" * 4000 + " " + "longest" * 4000 + " " + "longest" * 3999 + "longes " * 2),
            (6, "abababab ababababa abababab babababa babababab ababababa " * 2), (7, "aaaaaaa aaaaaaaa aaaaaaaaa " * 40)]
    rows += [(100 + i, text * n) for i, (text, n) in enumerate(chain)]
    rows += [(8, "repeated repeated"), (8, "repeated repeated")]
    assert result(spark, monkeypatch, rows) == by_force(rows)
    assert result(spark, monkeypatch, []) == []


@pytest.mark.parametrize("tile", [2, 8, 1024])
def test_large_groups_are_split_without_losing_a_pair(spark, monkeypatch, tile):
    """Few letters, so that most words share halves and many pairs are near."""
    draw = random.Random(5)
    words = {"".join(draw.choice("ab") for _ in range(draw.choice((7, 8, 9)))) for _ in range(500)}
    words |= {"commonprefix" + "".join(draw.choice("xyz") for _ in range(draw.choice((3, 4)))) for _ in range(80)}
    words |= {"".join(draw.choice("xyz") for _ in range(draw.choice((3, 4)))) + "commonsuffix" for _ in range(80)}
    words |= {"fixed" + chr(c) + "fixed" for c in range(0xC0, 0x100)}
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "TILE_ROWS", 4 * tile)
    monkeypatch.setattr(spelling, "AT_ONCE", 64)
    frame = spark.createDataFrame([(w, 2 + len(w)) for w in sorted(words)], "word string, n long")
    got = [(r.word, r.near) for r in spelling.near_pairs(frame).collect()]
    want = {(x, y) for x in words for y in words if x != y and one_edit(x, y)}
    assert len(got) == len(set(got)) and set(got) == want


def test_long_texts_and_full_dictionaries_change_nothing(spark, monkeypatch):
    rows = [(i, " ".join(f"{w}{'abcdefgh'[k % 8]}" for k, w in enumerate(("lettering", "Lettering", "lattering") * 30)))
            for i in range(20)]
    want = counted(rows)
    for counts, runs in ((2, 3), (200_000, 100_000)):
        monkeypatch.setattr(spelling, "COUNTED", counts)
        monkeypatch.setattr(spelling, "RUNS", runs)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.word: r.n for r in spelling.count_words(docs).where("n >= 2").collect()} == want
