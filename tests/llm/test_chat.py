import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from tracefold.llm.chat import conversation_digests, format_turn, format_turns, parse

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/OUT]", "[ROLE]", "\\", "<", "[", "/", "s>", "INST]", "\n", " ", "a", "é"]
texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
roles = st.one_of(st.sampled_from(["system", "user", "assistant", ""]), texts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(roles, texts), max_size=5))
def test_round_trip(turns):
    formatted = "".join(format_turn(r, t) for r, t in turns)
    assert [x[:2] for x in parse(formatted)] == turns


def test_harmless_text_stays():
    assert format_turn("user", "a < b [sic]") == "<s>[INST] a < b [sic] [/INST]</s>"


@pytest.mark.parametrize("text", ["", "x", "<s>[INST] a", "<s>[INST] a [/INST]", "<s>[INST] a [/OUT]</s>", "<s>[ROLE] user\nx [/ROLE]</s>"])
def test_malformed_is_refused(text):
    assert parse(text) in (None, [])


def want(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    sha, loss = hashlib.sha256(), ""
    for _, role, text in turns:
        sha.update(f"{role or ''}\n{text or ''}\n".encode())
        loss += (text or "") if role == "assistant" else ""
    return len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "tie"),
            (2, 0, None, None), (2, None, "assistant", "\\<s>"), (None, 3, "tool", "x" * 100_000), (3, 0, "user", ""),
            (3, 0, "user", "")]
    df = spark.createDataFrame([(*r, 9, "q") for r in rows],
                               "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    got = {r.conv_id: tuple(r)[1:] for r in conversation_digests(format_turns(df)).collect()}
    for conv in (1, 2, 3, None):
        assert got[conv][:4] == want([r[1:] for r in rows if r[0] == conv])
    assert conversation_digests(format_turns(df.limit(0))).count() == 0
