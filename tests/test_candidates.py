"""Graphs of the neighbours by embedding, on the smallest tables."""

import os

import pytest
from graphloom.plans import vector_queries as Q

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


def sources(spark):
    base = Q.node_vectors(spark, FOLDER)
    return base.count(), {r.id for r in Q._node_queries(base).collect()}


def test_supervised_graph_weighs_all_near_nodes(spark):
    n, queries = sources(spark)
    edges = [(r.u, r.v) for r in Q.supervised_graph(spark, FOLDER).collect()]
    assert queries and all(u in queries or v in queries for u, v in edges)
    for q in queries:
        assert sum(q in e for e in edges) >= min(Q.HEAVIEST, n - 1)


def test_pair_scores_reach_beyond_known_edges(spark):
    known = {(r.u, r.v) for r in Q.prior(spark, FOLDER).collect()}
    edges = {(r.u, r.v) for r in Q.pair_scored_candidates(spark, FOLDER).collect()}
    assert edges - known


def test_softmax_is_over_500_candidates(spark):
    """Against a softmax in numpy: the weights of a source, each edge being found once or from both sides."""
    import numpy as np

    rows = sorted((r.id, r.vector) for r in Q.embeddings(spark, FOLDER).collect())
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i, q in enumerate(ids):
        if q % Q.EVERY == 0:
            cos = np.delete(x @ x[i], i)
            others, best = np.delete(ids, i), np.argsort(-cos)[:500]
            e = np.exp((cos[best] - cos.max()) / 0.05)
            for j, w in zip(others[best][:20], (e / e.sum())[:20]):
                pair = (min(q, int(j)), max(q, int(j)))
                want[pair] = max(w, want.get(pair, 0))
    got = {(r.u, r.v): r.w for r in Q.QUERIES["knn_row_softmax_500"](spark, FOLDER).collect()}
    assert got == pytest.approx(want, abs=2e-6)
