import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF
from wearline.llm import packing
from wearline.llm.queries import op10_packing, tokenizer_file
from wearline.llm.tokens import WordTokenizer

PATH = tokenizer_file("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
OURS = WordTokenizer(PATH)


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aBcéÀßñIİıΣσς0१ .,!?'|_-\n\t\r\x0b\x1c\x1e\x85\xa0 éµ÷×漢ﬁ😀#%&*$"), max_size=40))
def test_ids_equal_the_tokenizer_s(text):
    assert np.frombuffer(OURS.encode(text), "<u4").tolist() == plain(text)
    assert b"".join(OURS.sentences(text)) == OURS.encode(text)


def test_special_strings_and_contractions():
    for text in ("a <|endoftext|>b", "don't we'll I'M", "x<|startoftext|>", "e.g. A. B! C? D", " ", "", "\n\n"):
        assert np.frombuffer(b"".join(OURS.sentences(text)), "<u4").tolist() == plain(text)


def best_by_force(at, penalty, window):
    cost = [0.0] + [np.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            size = at[j] - at[i]
            if size <= window:
                exact = size >= packing.LEAST_EXACT and size & (size - 1) == 0
                cost[j] = min(cost[j], cost[i] + (0 if exact else window - size) + penalty[j])
    return cost[-1]


def price(cuts, at, penalty, window):
    where = dict(zip(at, penalty))
    total = 0.0
    for a, b in zip(cuts, cuts[1:]):
        exact = b - a >= packing.LEAST_EXACT and (b - a) & (b - a - 1) == 0
        total += (0 if exact else window - b + a) + where[b]
    return total


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.sampled_from([0.0, 4.0, 48.0])), min_size=1, max_size=40))
def test_cuts_are_the_cheapest(steps):
    at, penalty = [0], [0.0]
    for size, cost in steps:
        at.append(at[-1] + size)
        penalty.append(cost)
    cuts = packing.best_cuts(at, penalty, 512)
    assert price(cuts, at, penalty, 512) == best_by_force(at, penalty, 512)


def check(docs, pieces):
    """docs: (id, text) with unique ids. Every id in one piece, sequences gapless, checksums right."""
    ids = {i: plain(t or "") + [1] for i, t in docs}
    done = {i: 0 for i in ids}
    for r in pieces.sort_values(["doc_id", "start"]).itertuples():
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == done[r.doc_id] and len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        done[r.doc_id] += r.length
    assert done == {i: len(x) for i, x in ids.items()}
    stored = 0
    for _, rows in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (rows["offset"] == rows["length"].cumsum() - rows["length"]).all()
        used = int(rows["length"].sum())
        assert used <= 2048
        stored += used if used & (used - 1) == 0 else 2048
    return sum(map(len, ids.values())) / max(stored, 1)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    filled = check(list(zip(docs["doc_id"], docs["text"])), op10_packing(spark, SF).toPandas())
    assert filled > 0.985


@pytest.mark.parametrize("run", [1, 3000, 1 << 20])
def test_odd_texts(spark, monkeypatch, tmp_path, run):
    monkeypatch.setattr(packing, "RUN_TOKENS", run)
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (4, "x" * 9000), (5, "One. Two! Three?\n\nFour"), (6, "One. Two!")]
    frame = spark.createDataFrame([(i, t, "?", "?") for i, t in rows],
                                  "doc_id long, text string, offset string, ids string").coalesce(1)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    check(rows, op10_packing(spark, str(tmp_path)).toPandas())


def test_order_is_kept_and_repeats_and_null_ids_are_documents(spark):
    rows = [(3, "c c c"), (None, "n"), (3, "c c c"), (1, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack_documents(frame, PATH).orderBy("sequence_id", "offset").toPandas()
    assert pieces["start"].eq(0).sum() == 4 and pieces["length"].sum() == 4 + 2 + 4 + 2
    first = pieces[pieces["start"] == 0]["doc_id"].tolist()
    assert [None if x != x else x for x in first] == [3, None, 3, 1]


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_what_a_worker_remembers_is_bounded_by_bytes():
    from wearline.llm.tokens import LONGEST, Remembering

    known = Remembering(lambda key: key.encode() * 4, limit=10_000)
    for k in range(500):
        assert known[f"chunk{k}"] == f"chunk{k}".encode() * 4
    assert 0 < len(known) < 45
    known["x" * (LONGEST + 1)]
    assert "x" * (LONGEST + 1) not in known
    tokenizer = WordTokenizer(PATH)
    before = len(tokenizer._chunks)
    tokenizer.encode("y" * 20_000)
    assert len(tokenizer._chunks) == before


def test_a_worker_that_forgets_finds_the_same_ids_again():
    from wearline.llm import tokens

    path, text = tokenizer_file("word_bpe_49k.json"), "Größe, size! 12 ünïts. " * 50
    held = tokens.word_tokenizer(path)
    before = held.encode(text)
    assert held._chunks and tokens.word_tokenizer(path) is held
    tokens.forget()
    tokens.forget()  # nothing is held any more
    assert not tokens._loaded and tokens.word_tokenizer(path).encode(text) == before


def test_a_word_is_remembered_and_looked_up_once():
    from wearline.llm.tokens import Remembering

    tokenizer, asked = WordTokenizer(PATH), []
    look_up = tokenizer._word
    tokenizer._word = lambda word: asked.append(word) or look_up(word)
    text = "harvest Harvest, HARVEST. harvest Été été! x1 harvest"
    assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == plain(text)
    assert asked == ["harvest", "été"]
    held = [key for kept in vars(tokenizer).values() if isinstance(kept, Remembering) for key in kept]
    assert held.count("harvest") == 1
