import re

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from wearline.llm import licenses as lic
from wearline.llm.queries import op4_license_scan

SCANNER = lic.Scanner()


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def base_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for phrase, label in lic.BASE.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


PARTS = st.sampled_from(["MIT", "license", "CC", "by", "cc-by", "GNU", "general", "public", "Apache", "\n", " ", ", ",
                         "é", "under the", "licensed", "version 2.0", "spdx-license-identifier:", "mit", "x", "{", "\x7f", "the"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=25).map(" ".join) | st.lists(PARTS, max_size=25).map("".join))
def test_base_phrases_and_ordered_rules_equal_brute_force(text):
    assert SCANNER.base(text.encode().lower()) == base_by_hand(text)
    low = lower(text)
    every = [lic.Detection(i, *m.span()) for i, r in enumerate(SCANNER.rules) for m in r.pattern.finditer(low)]
    assert SCANNER.detections(low) == lic.resolve(every, SCANNER.rules)


def labels(text):
    return [(SCANNER.rules[d.rule].label, SCANNER.rules[d.rule].kind) for d in SCANNER.detections(lower(text))]


def test_priority_and_containment():
    assert len(SCANNER.rules) > 200
    assert labels("Licensed under the Apache License, Version 2.0.") == [("apache", "grant")]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == [("gpl", "tag")]
    assert labels("the GNU Lesser General Public License v2.1") == [("lgpl", "versioned")]
    assert labels("new BSD license") == [("bsd-3", "name")]
    assert labels("Creative Commons Attribution-NonCommercial-ShareAlike") == [("cc-by-nc-sa", "name")]
    assert labels("https://www.gnu.org/licenses/gpl-3.0.html, MIT license") == [("gpl", "address"), ("mit", "name")]
    assert labels("permit license", ) == [] and labels("") == []


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_license_scan(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, places = base_by_hand(docs[r.doc_id])
        starts = [w for w, _ in places]
        own = {x for x, _ in labels(docs[r.doc_id])}
        base = {x for _, x in places}
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | own))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(base | own)


def test_odd_rows(spark):
    rows = [(None, "mit license"), (1, None), (2, ""), (3, "x " * 100_000 + "cc by"), (2, ""), (2 ** 60 + 1, "İ MIT LICENSE")]
    docs = spark.createDataFrame([(*r, "?", "?") for r in rows], "doc_id long, text string, base string, score string")
    found = lic.scan_licenses(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, [b.word for b in r.base]) for r in found) == sorted(
        (str(i), base_by_hand(t or "")[0], [w for w, _ in base_by_hand(t or "")[1]]) for i, t in rows)
    assert lic.scan_licenses(docs.where("false")).count() == 0
