import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from wearline.llm import chat
from wearline.llm.queries import ADDED_ID, ADDED_TEXT, op1_chat, tokenizer_file

CODING = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CODER = chat.ChatTokenizer(*CODING)
ODD = st.text(st.sampled_from("\\</turnsay> é漢\n😀") | st.characters(codec="utf-8"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(ODD | st.lists(st.sampled_from([*chat.MARKS, "\\", "<", "<turn", "<|endoftext|>", "says>"])).map("".join))
def test_escape_is_reversible_and_leaves_no_mark(content):
    escaped = chat.escape(content)
    assert chat.unescape(escaped) == content
    assert not any(mark in escaped for mark in chat.MARKS)
    ids, loss = chat.assemble(CODER, content, content, True)
    assert (ids >= chat.FIRST_RESERVED).sum() == 3
    assert chat.read_turn(CODER, ids, loss)[:3] == (content, content, content)


def expected(turns):
    """turns: (conv_id, turn, role, text) -> row by conversation."""
    out = {}
    for conv, _, role, text in sorted(turns, key=lambda t: (t[0], t[1])):
        out.setdefault(conv, []).append((role or "", text or ""))
    rows = {}
    for conv, said in out.items():
        trained = "".join(t for r, t in said if r == "assistant")
        rows[conv] = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(),
                      len(trained), hashlib.sha256(trained.encode()).hexdigest(),
                      sum(len(chat.escape(r)) + len(chat.escape(t)) + 19 for r, t in said))
    return rows


def found(result):
    return {r[0]: tuple(r)[1:] for r in result.collect()}


def test_whole_table(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    turns += [(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)]
    assert found(op1_chat(spark, SF)) == expected(turns)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_starts_are_gapless_with_blocks_nulls_repeats_and_clashing_names(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    turns = [(c, t, "assistant" if t % 2 else "user", f"text {t} </turn>" * (t % 3)) for c in (1, 2) for t in range(-4, 9)]
    turns += [(None, 0, None, None), (None, 5, "user", "x"), (3, 1, "user", "twice"), (3, 1, "user", "twice"),
              (4, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame([(*t, "?", 0) for t in turns],
                                  "conv_id long, turn long, role string, text string, start string, _block int")
    formatted = chat.format_conversations(frame, *CODING)
    rows = formatted.orderBy("conv_id", "start").collect()
    ends = {}
    for r in rows:
        assert r.start == ends.get(r.conv_id, 0) and len(r.ids) == len(r.loss)
        ends[r.conv_id] = r.start + len(r.ids)
    assert len(rows) == len(turns)
    own = {(-1 if c is None else c): v for c, v in found(chat.read_back(formatted, *CODING)).items()}
    assert own == expected([(-1 if c is None else c, *rest) for c, *rest in turns])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty, *CODING), *CODING).count() == 0
