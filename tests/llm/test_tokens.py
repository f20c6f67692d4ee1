import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronotier.llm import tokens

TOK = tokens.load(tokens.DEFAULT_VOCABULARY)
PARTS = ["a", "ab", "the ", "don't", "'s", "'ll", "  ", "\n\n", " \t", "12", "3", "é", "é", "你好", "。", "🙂", "👩‍👧", "!?", "...", "<|endoftext|>", " ", "　", "ﬁ", "日本", "क्", "-", "==", "\x00", "\x85"]


def joined(text, piece):
    return tokens.join_all(TOK, [TOK.encode(p) for p in tokens.halves(text, piece)])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.integers(2, 60))
def test_joins_are_exact(text, piece):
    assert joined(text, piece) == TOK.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300), st.integers(2, 80))
def test_joins_are_exact_on_any_text(text, piece):
    text = text.encode("utf-8", "ignore").decode()
    assert joined(text, piece) == TOK.encode(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "01", " ", " \n", "。了", "'s", "!-"])
def test_long_unbroken_runs(alphabet):
    rnd = random.Random(7)
    text = "".join(rnd.choice(alphabet) for _ in range(12_000))
    assert joined(text, 700) == TOK.encode(text)


def test_halves_make_up_the_text():
    text = "x" * 1001
    parts = tokens.halves(text, 100)
    assert "".join(parts) == text and max(map(len, parts)) <= 100


def test_documents(spark):
    rnd = random.Random(2)
    long = " ".join(rnd.choice(["word", "naïve", "你好", "x1"]) for _ in range(900))
    docs = [(1, "Hello world", "c"), (1, "Hello world", "c"), (2, "", "c"), (3, None, "c"), (None, "a b", "c"), (5, long, "c"), (6, "z" * 5000, "c"), (7, "<|endoftext|>", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids string")  # a column with a clashing name
    out = tokens.encode(df, long=1000, piece=300)
    assert out.columns == ["doc_id", "ids"]
    got = sorted(((r["doc_id"], r["ids"]) for r in out.collect()), key=repr)
    want = sorted(((d, TOK.encode(t or "")) for d, t, _ in docs), key=repr)
    assert got == want
    assert 50256 not in next(i for d, i in got if d == 7)


def test_no_documents(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_bytes_make_up_the_text():
    text = "naïve 🙂 \x00 你好"
    assert TOK.text(TOK.encode(text)) == text.encode()
