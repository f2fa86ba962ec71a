import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import orphans as O

DAY = datetime(2023, 1, 1)
at = lambda d: None if d is None else DAY + timedelta(days=d)


def brute(refs, parents):
    out = set()
    for tbl, rec, name, t in refs:
        own = [(s, e) for _, n, s, e in parents if n == name and n is not None and (e is None or s is None or e > s)]
        held = bool(own) if t is None else any((s is None or t >= s) and (e is None or t < e) for s, e in own)
        if not held:
            out.add((tbl, rec))
    return out


def case(seed, n=200):
    rng = random.Random(seed)
    name = lambda: rng.choice(["hot", "hot", *"abcdefgh", None])
    refs = [(rng.choice("xy"), i, name(), rng.choice([None, *range(0, 700, 7)])) for i in range(n)]
    parents = []
    for i in range(30):
        s = rng.choice([None, *range(0, 600, 11)])
        parents.append((i, name(), s, rng.choice([None, (s or 0) + rng.randrange(200)])))
    return refs, parents + [(99 + i, *p[1:]) for i, p in enumerate(parents[:5])]


REFERENCES = "tbl string, rec_id bigint, name string, at timestamp_ntz"
PARENTS = "pid bigint, name string, start timestamp_ntz, end timestamp_ntz"


def frames(spark, refs, parents, batches=1, seed=0):
    rng = random.Random(seed)
    r = spark.createDataFrame([(*x[:3], at(x[3]), "more", rng.randrange(batches)) for x in refs], REFERENCES + ", salt string, batch int")
    p = spark.createDataFrame([(x[0], x[1], at(x[2]), at(x[3]), 1, rng.randrange(batches)) for x in parents], PARENTS + ", spans int, batch int")
    return r, p


@pytest.mark.parametrize("clock,late", [([None], 1), ([100, 100, 500], 0), ([100, 300, 500, 600], 1), ([None, 30, 720], 0), ([10, 200, 720, 720], 2)])
def test_batches_equal_brute_force(spark, clock, late):
    refs, parents = case(1)
    r, p = frames(spark, refs, parents, len(clock))
    ledger = O.in_batches(r, p, [at(t) for t in clock], late)
    want = brute(refs, parents)
    assert {(x.tbl, x.rec_id) for x in ledger.pending.collect()} == want
    assert sum(x.n_orphans for x in ledger.snapshot().collect()) == len(want)
    after = [sum(x.n_orphans for x in ledger.snapshots().where(F.col("batch") == b).collect()) for b in range(len(clock))]
    moved = {x.batch: x for x in ledger.events().collect()}
    assert after[-1] == len(want)
    for b in range(1, len(clock)):
        assert after[b] - after[b - 1] == moved[b].n_new - moved[b].n_resolved + moved[b].n_reopened
    if len(clock) > 1:
        assert sum(x.n_resolved for x in moved.values()) and sum(x.n_reopened for x in moved.values())


def test_arrival_in_any_order(spark):
    """Late parents resolve waiting references, deletions reopen resolved ones; only changes are written."""
    r, p = frames(spark, [("x", 1, "a", 10), ("x", 2, "a", 50), ("x", 3, "b", 10), ("x", 4, "c", None)], [])
    state = O.OrphanLedger().advance(r, p)
    waiting = lambda s: {x.rec_id for x in s.pending.collect()}
    assert waiting(state) == {1, 2, 3, 4}
    _, p = frames(spark, [], [(1, "a", 5, None), (2, "c", 90, None)])
    state = state.advance(r.limit(0), p)
    assert waiting(state) == {3}
    _, p = frames(spark, [], [(1, "a", 5, 40)])
    state = state.advance(r.limit(0), p)
    assert waiting(state) == {2, 3}
    assert [c.count() for c in state.changes] == [4, 3, 1] and [v.count() for v in state.versions] == [0, 2, 1]
    assert [(x.batch, x.n_new, x.n_resolved, x.n_reopened) for x in state.events().orderBy("batch").collect()] == [(0, 4, 0, 0), (1, 0, 3, 0), (2, 0, 0, 1)]


def test_salted_batches(spark, monkeypatch):
    monkeypatch.setattr(O.skew, "hot_keys", lambda *_: ["hot"])
    refs, parents = case(7)
    assert {(x.tbl, x.rec_id) for x in O.in_batches(*frames(spark, refs, parents, 3), [at(50), at(300), at(600)]).pending.collect()} == brute(refs, parents)


def test_empty(spark):
    r, p = frames(spark, [], [])
    ledger = O.in_batches(r, p, [None, at(5)])
    assert ledger.pending.count() == 0 and ledger.snapshots().count() == 0


@settings(max_examples=4, deadline=None)
@given(st.integers(2, 10**6))
def test_probe(spark, seed):
    refs, parents = case(seed, 80)
    r, p = frames(spark, refs, parents)
    got = {(x.tbl, x.rec_id) for x in O.probe(r, p, ["hot"]).where(F.col("orphan")).collect()}
    assert got == brute(refs, parents)
