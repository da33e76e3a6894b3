"""Chat windows: exact round trips, digests against the turns themselves, and the budget."""

import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bramble.llm import chat
from bramble.llm.queries import QUERIES

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "/", "|", "s>", "SYS>>", "INST]", "a", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "odd\nrole\\n", "<s>"]), PIECES), min_size=1, max_size=12), st.integers(5, 60), st.integers(0, 30))
def test_windows_hold_each_turn_once(turns, budget, history):
    state, windows = chat.Windows(budget, history), []
    for role, text in turns:
        if (w := state.add(role, text)) is not None:
            windows.append(w)
    windows.append(state.close())
    new, lost = [], []
    for i, (number, text, repeated, loss) in enumerate(windows):
        got = list(chat.parse_window(text))
        assert number == i and (repeated == 0 or i > 0)
        if i and turns[0][0] == "system":
            assert got[0] == turns[0]
        tokens = sum(chat.count_tokens(t) for _, t in got)
        lead = chat.count_tokens(got[0][1]) if i and turns[0][0] == "system" else 0
        assert tokens <= budget or len(got) - repeated == 1 and tokens - lead - chat.count_tokens(got[-1][1]) == 0
        new += got[repeated:]
        lost += [chat.unescape(text[s["start"] : s["end"]]) for s in loss]
    assert new == turns
    assert lost == [t for r, t in turns if r == "assistant"]


def test_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b" * 9), (1, 0, "user", None), (1, 2, None, "x"), (2, 0, "system", "be brief"), *((2, i, "user" if i % 2 else "assistant", "word " * 200) for i in range(1, 40)), (3, 0, "user", "w " * 5000), (3, 0, "user", "w " * 5000), (None, None, "assistant", "")]
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op9_chat_format"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv, r in got.items():
        turns = sorted(((-1 if t is None else t, a or "", x or "") for c, t, a, x in rows if c == conv))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        loss = "".join(x for _, a, x in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_tokenizer_file(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", "some words of text " * 10) for i in range(8)], "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(turns, budget=120, history=50, tokenizer=path)
    rows = windows.collect()
    assert len(rows) > 1 and chat.read_back(windows).first().n_turns == 8


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in QUERIES["op9_chat_format"](spark, str(tmp_path)).collect()] == [-7]
