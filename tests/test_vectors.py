import numpy as np
import pytest
from graphloom.operators import vectors


def want(x, ids, m):
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    return {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in np.lexsort((ids, -s[i]))[:m]}


@pytest.mark.parametrize("block", [64, 65_536])
def test_many_ties(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "MOST_BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 8)).astype(np.float32).astype(float)
    x[rng.permutation(600)[:300]] = x[0]
    ids = rng.permutation(600)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vector array<float>")
    got = {(r.src, r.dst) for r in vectors.exact_neighbours(df, df, 20).collect()}
    assert got == want(x, ids, 20)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {(r.src, r.dst, r["rank"]) for r in vectors.exact_neighbours(df, df, 5).collect()}
    assert got == {(1, 2, 1), (1, 6, 2), (2, 1, 1), (2, 6, 2), (6, 1, 1), (6, 2, 2)}
    assert vectors.exact_neighbours(df.where("id = 9"), df, 5).count() == 0
    assert vectors.exact_neighbours(df, df.where("id = 9"), 5).count() == 0
