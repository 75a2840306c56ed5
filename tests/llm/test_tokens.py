import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeflow.llm import tokens

PIECES = ["abcde", "aaaa", "'s", "'ll", "  ", "\n\n", " ", "=", "==--", "123", "äöü", "日本語", "🙂", "\x1c", "\xa0", "don't", "THE", " the", "\t", "zq", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(PIECES)).map("".join), st.tuples(st.sampled_from(PIECES), st.integers(0, 300)).map(lambda x: x[0] * x[1])), st.integers(1, 40))
def test_tree_equals_direct(text, leaf):
    enc = tokens.encoding()
    assert tokens.encode(enc, text, leaf).tolist() == enc.encode_ordinary(text)


def test_long_unsplit_text():
    enc, r = tokens.encoding(), random.Random(8)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "=", "0123456789", "'sx", " ", "日本語文字"):
        text = "".join(r.choice(alphabet) for _ in range(30_000))
        assert tokens.encode(enc, text, 1_000).tolist() == enc.encode_ordinary(text)


def test_leaves_cover_the_text():
    text = "word " * 1000 + "x" * 5000
    parts = tokens.leaves(text, 300)
    assert "".join(text[a:b] for _, a, b, _ in parts) == text and all(b - a <= 300 for _, a, b, _ in parts)
    assert any(sure for *_, sure in parts[1:]) and not all(sure for *_, sure in parts)


@pytest.mark.parametrize("apart", [10, tokens.APART])
def test_corpus(spark, monkeypatch, apart):
    monkeypatch.setattr(tokens, "APART", apart)
    texts = [None, "", " ", "Hello world", "Hello world", "x" * 20_000, "one two " * 3_000, "<|endoftext|>", "é́🙂"]
    df = spark.createDataFrame([(i if i else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    enc = tokens.encoding()
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df, leaf=500).collect()}
    assert got == {(i if i else None): enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, leaf=500).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    again = tokens.encode_corpus(df.unionByName(df)).collect()
    assert len(again) == 2 * len(texts)
    assert tokens.encode_corpus(df.limit(0)).collect() == []


def test_decoded_ids_are_the_texts(spark):
    texts = ["a b", "", None, "naïve \U0001f600 x\r\n", "don't " * 9000, "ü" * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_tokens"]) for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert [got[i][0] for i in range(6)] == [t or "" for t in texts] and got[1][1] == got[2][1] == 0
    assert tokens.decode_corpus(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] == ""
