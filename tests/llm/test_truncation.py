import json
import random

from graphloom.llm import truncation as T

RNG = random.Random(5)
NOUNS = ["market", "layer", "index", "harbour", "signal", "orchard", "glacier"]


def notebook(n, kind):
    prose = lambda: f"The {RNG.choice(NOUNS)} of {RNG.choice(NOUNS)} looks late, so we filter it against a normal {RNG.choice(NOUNS)}."
    code = lambda: f"x{RNG.randrange(9)} = load_table('{RNG.choice(NOUNS)}/part_{RNG.randrange(99)}.parquet')"
    cells = [(RNG.choice(["markdown", "code"])) for _ in range(n)]
    if kind == "json":
        return json.dumps({"cells": [{"cell_type": c, "source": [prose() if c == "markdown" else code()]} for c in cells], "nbformat": 4})
    if kind == "script":
        return "\n\n".join("# %% [markdown]\n# " + prose() if c == "markdown" else "# %%\n" + code() for c in cells)
    return "\n\n".join(prose() if c == "markdown" else f"```python\n{code()}\n```" for c in cells)


def corpus():
    rows, cut = [], set()
    for i in range(500):
        t = notebook(RNG.randint(3, 14), RNG.choice(["json", "script", "md"]))
        if i % 10 == 0:
            t, limit = t[: len(t) * 2 // 3], None
            while not t[-1].isalpha() or t.endswith((".", "`")):
                t = t[:-1]
            t = t[:-1]
            cut.add(i)
        rows.append((i, t, RNG.choice(["a", "b", None])))
    return rows + [(900, None, "a"), (901, "", "a"), (902, " \n", "b"), (903, "word " * 60_000 + "end.", "b")], cut


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, k int, f string")
    got = {r.doc_id: r.score for r in T.score(df, "doc_id", "text", "source").collect()}
    assert set(got) == {r[0] for r in rows if r[1] and r[1].strip()}
    found = {i for i, s in got.items() if s >= T.DECISION}
    assert len(found & cut) >= 0.9 * len(cut)
    assert len(found - cut) <= 0.02 * len(rows)


def test_empty(spark):
    assert T.score(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "text", "source").count() == 0
    one = spark.createDataFrame([(1, "short", "a")], "doc_id long, text string, source string")
    assert T.score(one, "doc_id", "text", "source").count() == 1


def test_limits(spark):
    rows = [("a", 5000, 5000, i) for i in range(30)] + [("a", i, i, 100 + i) for i in range(400, 3000)] + [("b", 5000, 5010, 7)]
    got = T.field_limits(spark.createDataFrame(rows, "source string, chars int, bytes int, h long"))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [("bytes", 5000), ("chars", 5000)]}


def test_held_out_rows(spark):
    df = spark.createDataFrame(corpus()[0], "doc_id long, text string, source string")
    got = {r.label: r.n_called_cut / r.n for r in T.held_out_accuracy(df, "doc_id", "text", "source").collect()}
    assert got[1.0] >= 0.9 and got[0.0] <= 0.1
    assert T.held_out_accuracy(df.limit(0), "doc_id", "text", "source").count() == 0


def test_whole_texts_count():
    text = "# %%\nsplendidly = 1\n" + "x = 2\n" * 3000 + "splendidly"
    found, _, word = T.features(text, [])
    assert word == "splendidly" and any(f.endswith("here True|False") for f in found)
    assert T.features('{"metadata": {' + '"a": 1, ' * 500 + '"b": 2}, "cells": [{"so', [])[0][0] == "json open"
