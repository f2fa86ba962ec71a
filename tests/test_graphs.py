import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import diffusion, graphs, metrics, normalize, splits, vectors
from graphloom.operators import edges as E
from graphloom.operators.ranking import ranked
from pyspark.sql import functions as F

EDGE = "u string, v string, w double, line_no long"


def edges(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDGE)


def got(df):
    return {(r.u, r.v): r.w for r in df.collect()}


def test_merge(spark):
    rows = [("a", "b", 1.0), ("b", "a", 3.0), ("a", "b", 2.0), ("a", "a", 9.0), ("a", "c", 0.0), ("d", "a", -1.0), ("e", "f", float("nan")), (None, "a", 1.0), ("x", "y", None)]
    assert got(graphs.merge_parts(edges(spark, rows))) == {("a", "b"): 3.0}
    assert got(E.merge_max(edges(spark, rows))) == {("a", "b"): 3.0, ("a", "c"): 0.0, ("a", "d"): -1.0}
    assert got(E.last_of_pair(edges(spark, rows), "line_no"))["a", "b"] == 2.0
    assert graphs.merge_parts(edges(spark, [])).count() == 0


PAIRS = st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd"), st.floats(-1, 1)), min_size=1, max_size=20)


@settings(max_examples=8, deadline=None)
@given(PAIRS)
def test_merge_is_idempotent_and_order_free(spark, rows):
    once = got(E.merge_max(edges(spark, rows)))
    assert once == got(E.merge_max(edges(spark, rows[::-1] + rows)))
    assert all(u < v for u, v in once)


def test_reweight_and_mix(spark):
    prior = edges(spark, [("a", "b", 1.0), ("a", "c", 0.0), ("b", "a", 1.0)])
    signal = edges(spark, [("a", "b", 0.2), ("b", "a", 0.4), ("d", "e", 0.5)])
    out = graphs.reweight(prior, signal).collect()
    assert sorted((r.u, r.v) for r in out) == [("a", "b"), ("a", "c"), ("b", "a")]
    mix = got(graphs.gated_mix(prior, signal))
    assert mix["a", "b"] == pytest.approx(2 * 0.5 * math.exp(0.4) + 0.5 * 0.2 + 0.5 * 0.4) and mix["d", "e"] == 0.25 and ("a", "c") not in mix
    plain = got(graphs.reweight(prior, signal, beta=0.0))
    assert plain == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "a"): 1.0}
    assert got(graphs.gated_mix(edges(spark, []), signal))["d", "e"] == 0.25
    assert graphs.reweight(edges(spark, []), signal).count() == 0
    whole = got(graphs.gated_mix(prior, signal, share=1.0))
    assert whole == pytest.approx(got(E.positive(E.merge_sum(graphs.reweight(prior, signal)))))


def test_normalisations(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0), ("b", "y", 2.0)], "src string, dst string, w double")
    w = lambda d: {(r.src, r.dst): r.w for r in d.collect()}
    assert w(normalize.over_source(df, "minmax")) == {("a", "x"): 0, ("a", "y"): 1, ("b", "x"): 0, ("b", "y"): 0}
    assert w(normalize.over_source(df, "sigmoid_z"))["a", "y"] == pytest.approx(1 / (1 + math.exp(-1)))
    assert w(normalize.over_source(df, "softmax"))["b", "x"] == pytest.approx(0.5)
    assert w(normalize.over_graph(df, "clip01"))["a", "y"] == 1
    constant = df.withColumn("w", F.lit(2.0))
    assert set(w(normalize.over_graph(constant, "minmax")).values()) == {0.0}
    with pytest.raises(ValueError):
        normalize.over_graph(df, "other")


def test_exact_neighbours(spark):
    x = np.random.default_rng(0).standard_normal((70, 6))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(100, None), (101, [1.0]), (102, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    out = vectors.exact_neighbours(df.where("id % 5 = 0"), df, 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 70, 5):
        s = u @ u[q]
        s[q] = -9
        assert [r.dst for r in sorted((r for r in out if r.src == q), key=lambda r: r["rank"])] == np.argsort(-s)[:4].tolist()


def networkx_like(pairs, seeds, alpha=0.85, rounds=500):
    ids = sorted({a for p in pairs for a in p[:2]})
    m = np.zeros((len(ids), len(ids)))
    for u, v, w in pairs:
        m[ids.index(u), ids.index(v)] += w
        m[ids.index(v), ids.index(u)] += w
    m /= m.sum(axis=1, keepdims=True)
    p = np.array([seeds.get(i, 0.0) for i in ids])
    p /= p.sum()
    x = np.full(len(ids), 1 / len(ids))
    for _ in range(rounds):
        x = alpha * x @ m + (1 - alpha) * p
    return dict(zip(ids, x))


def test_hot_nodes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(diffusion.skew, "hot_keys", lambda *_: ["a"])
    pairs = [("a", f"n{i}", 1.0 + i) for i in range(30)] + [("n3", "n4", 2.0)]
    g = spark.createDataFrame([("g", *p) for p in pairs], "graph string, u string, v string, w double")
    seeds = spark.createDataFrame([("n1", 1.0)], "id string, weight double")
    scores = {r.id: r.score for r in diffusion.pagerank(g, seeds, iterations=4, tolerance=None, every=2).collect()}
    assert scores == pytest.approx(networkx_like(pairs, {"n1": 1.0}, rounds=4))


def test_pagerank(spark):
    one = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 0.5), ("e", "f", 1.0)] + [("a", f"n{i}", 0.1) for i in range(20)]
    two = [("a", "z", 1.0), ("z", "y", 3.0)]
    rows = [("one", *r) for r in one] + [("two", *r) for r in two] + [("none", "p", "q", 1.0)]
    g = spark.createDataFrame(rows, "graph string, u string, v string, w double")
    seeds = spark.createDataFrame([("a", 1.0), ("a", None), ("d", 1.0), ("c", -1.0), (None, 1.0), ("gone", 5.0)], "id string, weight double")
    out = diffusion.pagerank(g, seeds, tolerance=1e-7).collect()
    assert all(r.converged for r in out) and {r.graph for r in out} == {"one", "two"}
    for name, pairs, s in (("one", one, {"a": 2.0, "d": 1.0}), ("two", two, {"a": 2.0})):
        scores = {r.id: r.score for r in out if r.graph == name}
        assert scores == pytest.approx(networkx_like(pairs, s), abs=1e-5)
        assert sum(scores.values()) == pytest.approx(1)
    assert {r.iterations for r in diffusion.pagerank(g, seeds, iterations=3, tolerance=None).collect()} == {3}
    assert [r.graph for r in diffusion.without_seeds(g, seeds).collect()] == ["none"]


def test_metrics(spark):
    scored = spark.createDataFrame(
        [("g", f"n{i}", 1.0 - i / 10, 1.0 if i < 2 else 0.0) for i in range(5)] + [("h", "a", 0.5, 0.0), ("h", "b", 0.5, 0.0)],
        "graph string, id string, score double, y double",
    )
    out = {r.graph: r for r in metrics.best_first(metrics.summary(scored, 3)).collect()}
    assert out["g"].auprc == 1 and out["g"].precision_at_k == pytest.approx(2 / 3) and out["g"].recall_at_k == 1
    assert out["g"].enrich_factor_at_k == pytest.approx((2 / 3) / (2 / 5))
    assert math.isnan(out["h"].auprc) and out["h"].enrich_factor_at_k is None and out["h"].recall_at_k == 0 and out["h"].precision_at_k == 0
    assert out["h"].place == 1  # what has no value comes first
    labels = spark.createDataFrame([("a", 1.0, 1), ("a", 0.0, 2), ("b", float("nan"), 1), ("c", 2.0, 1), (None, 1.0, 1), ("d", None, 1)], "id string, value double, n int")
    assert {r.id: r.y for r in metrics.label_map(labels, "n").collect()} == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_ranked_equals_a_window(spark):
    rows = [(i % 3, (i * 37) % 11 / 10, i, float(i % 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, x double, id int, y double")
    want = {}
    for g in range(3):
        total = 0.0
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            total += r[3]
            want[r[2]] = (k + 1, total)
    assert {r.id: (r["rank"], r.running) for r in ranked(df, [F.desc("x"), F.asc("id")], ["g"], "y").collect()} == want


def test_splits(spark):
    df = edges(spark, [(f"n{i}", f"n{(i * 7 + 1) % 50}", 1.0) for i in range(50)] + [("n1", "n8", 1.0)])
    pairs = E.distinct_pairs(df).count()
    out = splits.edge_split(df)
    assert out.count() == pairs == out.select("u", "v").distinct().count()
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes["train"] == int(pairs * 0.8) and sizes["val"] == int(pairs * 0.1)
    parted = splits.node_split(df, seed=1).collect()
    parts = {}
    for r in parted:
        assert parts.setdefault(r.u, r.split) == r.split == parts.setdefault(r.v, r.split)
    neg = splits.negatives(df)
    assert neg.count() == pairs and neg.join(E.distinct_pairs(df), ["u", "v"]).count() == 0
    assert splits.edge_split(df.limit(0)).count() == 0


def test_joint_surplus(spark):
    items = spark.createDataFrame([("a", "MKV"), ("b", "MKVL"), ("c", None)], "id string, seq string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "gone")], "src string, dst string")
    out = {(r.src, r.dst): r.w for r in graphs.joint_surplus(pairs, items, F.length, linker=4).collect()}
    assert out == {("a", "b"): 4.0, ("a", "c"): 0.0}


def test_negatives_of_a_dense_graph(spark):
    """All pairs that are no edges are found, though there are few."""
    every = [(f"n{i}", f"n{j}", 1.0) for i in range(8) for j in range(i + 1, 8)]
    df = edges(spark, every[3:])
    assert {(r.u, r.v) for r in splits.negatives(df, most=16).collect()} == {p[:2] for p in every[:3]}


def test_scored_graph(spark):
    items = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", float("nan"))], "id string, x double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a")], "src string, dst string")
    assert got(graphs.scored_graph(pairs, items, F.col("a.x") * F.col("b.x"), norm="raw")) == {("a", "b"): 2.0}


def test_converged_only_where_tested(spark):
    g = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 2.0)], "graph string, u string, v string, w double")
    seeds = spark.createDataFrame([("a", 1.0)], "id string, weight double")
    assert {r.converged for r in diffusion.pagerank(g, seeds, iterations=2, tolerance=None).collect()} == {None}
    assert {r.converged for r in diffusion.pagerank(g, seeds, iterations=1).collect()} == {False}
