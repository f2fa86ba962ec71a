import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import leakage as L

RNG = random.Random(3)
WORDS = [f"w{RNG.randrange(10**6)}" for _ in range(400)]
ITEM = [RNG.choice(WORDS) for _ in range(80)]
OTHER = [RNG.choice(WORDS) for _ in range(60)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 50), st.integers(0, 50), st.integers(L.GRAM + L.WINDOW - 1, 30))
def test_a_long_shared_run_shares_a_fingerprint(before, after, size):
    rng = random.Random(before * 1000 + after)
    run = [f"s{i}" for i in range(size)]
    texts = [[f"a{rng.random()}" for _ in range(before)] + run + [f"b{rng.random()}" for _ in range(after)], [f"c{rng.random()}" for _ in range(after)] + run]
    no, _, h = L.fingerprints(texts, L._Hashes())
    assert set(h[no == 0]) & set(h[no == 1])


def test_words():
    assert L.words("# To *mask* the\\nlayer,\\u00e9t\\u00e9 `a_b`") == ["to", "mask", "the", "layer", "été", "a", "b"]
    assert L.words("数検a1") == ["数", "検", "a1"]


def texts():
    changed = [w if i % 10 != 5 else "other" for i, w in enumerate(ITEM)]
    half, less = ITEM[:42], ITEM[:30]
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["intro\n", " ".join(ITEM[:40]) + ",\n", "**" + " ".join(ITEM[40:]).upper() + "**"]}]})
    return {
        1: " ".join(ITEM), 2: " ".join(changed), 3: "start " + " ".join(half) + " end", 4: " ".join(less), 5: nb,
        6: "\n".join("#   " + " ".join(ITEM[i : i + 7]) for i in range(0, 80, 7)), 7: None, 8: "", 9: " \n", 10: " ".join(RNG.sample(ITEM, 80)),
        11: "filler " * 50_000 + " ".join(ITEM), 12: " ".join(ITEM),
    }


def run(spark, docs, items):
    d = spark.createDataFrame([(k, v, 0, "x") for k, v in docs.items()], "doc_id long, text string, item_id int, t string")
    i = spark.createDataFrame([(k, v, 0) for k, v in items.items()], "item_id long, text string, d int")
    return {(r.doc_id, r.item_id) for r in L.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}


def test_found(spark, monkeypatch):
    items = {100: " ".join(ITEM), 101: " ".join(ITEM), 102: " ".join(OTHER), 103: None, 104: ""}
    want = {(d, i) for d in (1, 2, 3, 5, 6, 11, 12) for i in (100, 101)}
    assert run(spark, texts(), items) == want
    monkeypatch.setattr(L, "AT_ONCE", 30)  # several passes
    assert run(spark, texts(), items) == want


def test_empty_tables(spark):
    assert run(spark, {}, {1: "a b"}) == set() and run(spark, {1: "a b"}, {}) == set()
