import numpy as np

from graphloom.llm.similar_vectors import most_similar

SCHEMA = "rec_id long, emb array<float>, id string, vector int, h int"


def exact(x, ids, k):
    x = x.astype(np.float32).astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.lexsort((ids, -np.round(row, 12)))[:k]] for i, row in zip(ids, s)}


def run(spark, rows, k=5, size=8):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x", 1, 2) for i, v in rows], SCHEMA)
    out = {}
    for r in most_similar(df, "rec_id", "emb", k, size).collect():
        out.setdefault(r.rec_id, []).append((r["rank"], r.neighbour))
    return {i: [n for _, n in sorted(v)] for i, v in out.items()}


def recall(got, want, k=5):
    return np.mean([len(set(want[i]) & set(got[i])) / k for i in want])


def test_small_set(spark):
    x = np.random.default_rng(0).standard_normal((40, 8))
    ids = np.arange(100, 140)
    assert recall(run(spark, list(zip(ids.tolist(), x))), exact(x, ids, 5)) >= 0.97


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((60, 1, 8)) + 0.2 * rng.standard_normal((60, 25, 8))).reshape(-1, 8)
    ids = np.arange(len(x))
    want, got = exact(x, ids, 5), run(spark, list(zip(ids.tolist(), x)))
    assert recall(got, want) >= 0.95


def test_copies_and_unusable(spark):
    a, b = [1.0] + [0.0] * 7, [0.9, 0.1] + [0.0] * 6
    bad = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 7, [-0.0] * 8]
    rows = [(i, a) for i in range(1, 10)] + [(20, b)] + [(30 + i, v) for i, v in enumerate(bad)]
    got = run(spark, rows, k=3)
    assert got[1] == [2, 3, 4] and got[2] == [1, 3, 4] and got[9] == [1, 2, 3] and got[20] == [1, 2, 3]
    assert set(got) == set(range(1, 10)) | {20}
    assert run(spark, [(1, a)]) == {} and run(spark, []) == {}


def test_large_cells_are_divided(spark, monkeypatch):
    from graphloom.llm import similar_vectors

    monkeypatch.setattr(similar_vectors, "BLOCK", 10)
    x = np.random.default_rng(2).standard_normal((60, 8))
    ids = np.arange(60)
    assert recall(run(spark, list(zip(ids.tolist(), x))), exact(x, ids, 5)) >= 0.97


def test_farthest():
    from graphloom.llm.similar_vectors import _farthest

    x = np.random.default_rng(3).standard_normal((50, 1500)).astype(np.float32)
    for d in (9, 300, 1500):
        row, column = _farthest(x, np.eye(1500, dtype=np.float32)[:d], 8)
        want = np.sort(np.argsort(-x[:, :d], axis=1)[:, :8], axis=1)
        assert np.array_equal(row, np.repeat(np.arange(50), 8))
        assert np.array_equal(np.sort(column.reshape(50, 8), axis=1), want)


def test_windows_are_counted():
    from graphloom.llm.similar_vectors import _at_least, _sets_before

    rng = np.random.default_rng(4)
    for m in (5, 70, 700):
        table = rng.standard_normal((6, m))
        order = np.argsort(table, axis=1)
        before, step = _sets_before(order)
        low = rng.integers(0, m, (6, 20)) // step * step
        high = np.minimum(low + rng.integers(0, m, (6, 20)) // step * step, before.shape[1] * step - step)
        planes, want = [np.zeros((20, before.shape[2]), dtype=np.uint64) for _ in range(3)], np.zeros((20, m), dtype=int)
        for p in range(6):
            carry = before[p, high[p] // step] ^ before[p, low[p] // step]
            for i in range(3):
                planes[i], carry = planes[i] ^ carry, planes[i] & carry
            for q in range(20):
                want[q, order[p, low[p, q] : high[p, q]]] += 1
        for need in range(1, 7):
            got = np.unpackbits(_at_least(planes, need).view(np.uint8), axis=1, bitorder="little", count=m)
            assert np.array_equal(got.astype(bool), want >= need)


def test_no_search_takes_the_whole_cell():
    from graphloom.llm.similar_vectors import _Search

    rng = np.random.default_rng(5)
    x = (rng.standard_normal((300, 1, 64)) + 0.3 * rng.standard_normal((300, 8, 64))).reshape(-1, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    task = _Search(np.arange(len(x)), x, 10)
    task.run()
    assert task.whole <= 0.05 * task.searches
