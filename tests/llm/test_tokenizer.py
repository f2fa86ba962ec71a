import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary here")

PARTS = st.sampled_from(["a", "the", " ", "  ", "\n", "'", "'s", "'ll", "l", "re", "0", "17", "!", "((", "é", "ß", "河", "値", "́", "🙂", "\t", " ", "AAAA", "ZmFrZQ", "=" * 9, "<|endoftext|>"])


def joined(bpe, a, b):
    left, right = bpe.encode(a), bpe.encode(b)
    found = bpe.seam(left, right)
    if found is None:
        return None
    off_left, between, off_right = found
    return np.concatenate([left[: len(left) - off_left], between, right[off_right:]])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=40), st.integers(0, 60))
def test_join_equals_direct_encoding(parts, at):
    bpe = tokenizer.encoder(tokenizer.VOCABULARY)
    text = "".join(parts)
    got = joined(bpe, text[:at], text[at:])
    assert got is None or np.array_equal(got, bpe.encode(text))


def test_joins_are_found():
    bpe = tokenizer.encoder(tokenizer.VOCABULARY)
    for text in ("the market isn't late, so " * 40, "Ab3" * 400, "thequickbrownfox" * 99):
        for at in (500, 601, 777):
            assert np.array_equal(joined(bpe, text[:at], text[at:]), bpe.encode(text))


UNSPLIT = ["A" * 9000, "Ab3" * 4000, " " * 5000 + "x", "河模明" * 3000, "x" + " " * 7000, "abcdefghij" * 1500, "!?" * 4000, "́" * 3000, "thequickbrownfox" * 999, "0" * 6000, "🙂" * 2500, "a é" * 3000]


@pytest.mark.parametrize("leaf", [300, 700])
def test_unsplit_texts(spark, leaf):
    """Every text under the same key."""
    df = spark.createDataFrame([(7, t) for t in UNSPLIT], "doc_id long, text string")
    got = sorted(r.ids for r in tokenizer.encode_corpus(df, "doc_id", "text", leaf=leaf).collect())
    bpe = tokenizer.encoder(tokenizer.VOCABULARY)
    assert got == sorted(bpe.encode(t).tolist() for t in UNSPLIT)


def test_corpus(spark):
    texts = [None, "", " \n", "It's <|endoftext|> here", "word " * 500, "x" * 3000, "It's <|endoftext|> here"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokenizer.encode_corpus(df, "doc_id", "text", leaf=200).collect()}
    bpe = tokenizer.encoder(tokenizer.VOCABULARY)
    assert got == {i: bpe.encode(t or "").tolist() for i, t in enumerate(texts)}
    assert tokenizer.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
