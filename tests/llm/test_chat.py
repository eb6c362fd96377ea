"""Chat formatting: exact round trips, masks against character sets, and odd rows."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from triagelake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, ids int"
TEXTS = st.text(alphabet="ab \\<>/\n\t:#é日🎉|turnd", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a>b\n", ""]), TEXTS), max_size=6))
def test_rendering_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXTS), min_size=1, max_size=5))
def test_mask_holds_each_answer_once(turns):
    text, spans = chat.render(turns)
    found = chat.tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False)
    hits = chat.mask(np.array(found.offsets).reshape(-1, 2), spans)
    assert chat.masked_text(text, [s for _, s, _ in hits], [e for *_, e in hits]) == "".join(t for r, t in turns if r == "assistant")
    inside = {k for k, (a, b) in enumerate(found.offsets) for s, e in spans if max(a, s) < min(b, e)}
    assert {k for k, _, _ in hits} == inside


def test_query_on_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo <turn user>\n\\"), (2, 1, "assistant", None), (2, 0, None, "x"), (3, 0, "assistant", "a" * 9000 + "é"),
        (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (None, 0, "user", "lost"), (5, None, "assistant", "no turn"), (5, 0, "user", "</turn>"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r.conv_id: r for r in chat.chat_query(spark, df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None, -7}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\nhi\nassistant\nyo <turn user>\n\\\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (17 - 1, digest("yo <turn user>\n\\"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars) == (2, digest("\nx\nassistant\n\n"), 0)
    assert got[3].loss_chars == 9001
    assert (got[4].n_turns, got[4].loss_sha256) == (2, digest("samesame"))
    assert got[5].turns_sha256 == digest("assistant\nno turn\nuser\n</turn>\n")
    assert got[-7].loss_sha256 == digest(chat.PROBE) and got[-7].n_turns == 2
    assert got[-7].formatted_chars == len(chat.render([("user", chat.PROBE), ("assistant", chat.PROBE)])[0])
    empty = spark.createDataFrame([], SCHEMA)
    assert [r.conv_id for r in chat.chat_query(spark, empty).collect()] == [-7]


def test_ids_missing_taken_or_of_other_types(spark):
    rows = [(None, 0, "user", f"lost {k}") for k in range(30)] + [("-7", 0, "assistant", "here before"), ("x", 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = [(r.conv_id, r.n_turns, r.loss_chars) for r in chat.chat_query(spark, df).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 0)] * 30 + [("-7", 1, 11), ("-7", 2, len(chat.PROBE)), ("x", 1, 0)], key=str)
    exact = df.selectExpr("cast(1.5 as decimal(4,1)) as conv_id", "turn", "role", "text")
    assert chat.format_chats(exact).count() == 1
