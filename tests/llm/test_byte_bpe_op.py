import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from wearline.llm import byte_bpe, queries
from wearline.llm.byte_bpe import ByteCoder, Coding, decode_documents, encode_documents

CODING = Coding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe._ranks(CODING.path), special_tokens={})
OURS = ByteCoder(CODING)
SCHEMA = "doc_id long, text string, ids string, chunk int"


def plain(text):
    return np.array(PLAIN.encode_ordinary(text or ""), "<u4").tobytes()


def digest(data):
    return hashlib.sha256(data).hexdigest()


def by_force(rows):
    return sorted(((i, len(plain(t)) // 4, digest(plain(t)), digest((t or "").encode())) for i, t in rows), key=str)


def result(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(*r, "ids", 1) for r in rows], SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *_: docs.repartition(3))
    return sorted((tuple(r) for r in queries.op11_byte_bpe(spark, "").collect()), key=str)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("abS'strevemlld 12 \n\t\r\x1c\x85\xa0 .,;é漢😀՘࢏\U00011de0ÿ"),
                                      max_size=60))
def test_ids_equal_the_library_s(text):
    text = text.encode("utf-8", "ignore").decode()
    assert OURS.encode(text) == plain(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


def test_every_code_point_is_classed_as_the_library_does():
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for wrap in ("x{0}x", "1{0}1", " {0}{0}"):
        for at in range(0, len(every), 5000):
            text = "\n".join(wrap.format(c) for c in every[at:at + 5000])
            assert OURS.encode(text) == plain(text)


def test_query_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_byte_bpe(spark, SF).collect()), key=str) == by_force(rows)


ODD = [(1, None), (2, ""), (3, " "), (None, "no id"), (None, "no id"), (4, "twice"), (4, "twice"), (5, "don't we'll " * 40),
       (6, "z" * 900), (7, " " * 700 + "x"), (8, "\n" * 333 + " a" * 300), (9, "漢字" * 200), (10, "😀 ՘՘ " * 90),
       (11, "word " * 64 + "y" * 200 + " word" * 64), (12, "!" * 500 + "?" * 20), (13, "ab cd " * 100 + "'" * 64 + "re" * 64),
       (14, "a" * 64 + " " * 64 + "1" * 64 + "\n" * 64 + "a" * 63 + "'" + "re" + " " * 61), (15, "x " * 32), (16, "x " * 33)]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (64, 32), (50, 9), (1 << 15, 1 << 10)])
def test_odd_rows_and_seams_against_the_library(spark, monkeypatch, chunk, overlap):
    monkeypatch.setattr(byte_bpe, "CHUNK", chunk)
    monkeypatch.setattr(byte_bpe, "OVERLAP", overlap)
    assert result(spark, monkeypatch, ODD) == by_force(ODD)


def test_very_long_texts(spark, monkeypatch):
    rows = [(1, "Some words, 12 of them. " * 20_000), (2, "q" * 200_000), (3, "é ü\n\n  x" * 30_000), (4, " " * 100_000)]
    assert result(spark, monkeypatch, rows) == by_force(rows)


def test_empty_table_and_other_ids(spark, monkeypatch):
    assert result(spark, monkeypatch, []) == []
    docs = spark.createDataFrame([("a", "one two"), (None, "w " * 40_000)], "name string, body string")
    coded = decode_documents(encode_documents(docs, *CODING, id_column="name", text="body"), *CODING).collect()
    assert {r.doc_id: (bytes(r.ids), bytes(r.decoded).decode()) for r in coded} == {
        "a": (plain("one two"), "one two"), None: (plain("w " * 40_000), "w " * 40_000)}
