import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import split_items as S

PARTS = st.sampled_from(["MKV" * 40, "*", "GGGGS" * 6, "XXXXXXXXXXXX", "acdefghiklmnp", "ACDEFGHIKL" * 30, "-", "\n", "7", "Q"])


def pieces_of(seq, longest=300, overlap=60):
    letters = re.sub("[^A-Za-z]", "", seq)
    ends, start, out = S.cuts(seq, len(letters), longest, overlap), 0, []
    for end in ends:
        out.append((start, end))
        start = end - overlap
    return letters, out


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=30))
def test_pieces_cover_and_overlap(parts):
    letters, out = pieces_of("".join(parts))
    assert out[0][0] == 0 and out[-1][1] == len(letters)
    assert all(e - s <= 300 for s, e in out)
    assert all(b[0] == a[1] - 60 and a[1] < b[1] for a, b in zip(out, out[1:]))
    assert len(out) == 1 or len(letters) > 300


def cheapest(seq, length, longest, overlap):
    """All chains of boundaries, tried one by one."""
    share = (length - overlap) / (1 + -(-(length - longest) // (longest - overlap)))
    places, cost = S.boundaries(seq, length)
    cost = dict(zip(places.tolist(), cost.tolist())) | {length: 0.0}
    best = {}

    def rest(at):
        if at == length:
            return 0.0
        if at not in best:
            steps = [p for p in cost if at < p <= (at + longest - overlap if at else longest) and (at or p > overlap)]
            size = lambda p: p - at if at else p - overlap
            best[at] = min((cost[p] + S.IMBALANCE * ((size(p) - share) / share) ** 2 + rest(p) for p in steps), default=float("inf"))
        return best[at]

    return rest(0), cost, share


def test_chain_is_the_cheapest():
    seq = "ACDEFGHIKL" * 17 + "*" + "MNPQRSTVWY" * 13 + "GGGGSGGGGSGGGGS" + "ACDEFGHIKL" * 25
    length = len(re.sub("[^A-Za-z]", "", seq))
    want, cost, share = cheapest(seq, length, 200, 40)
    ends, got, at = S.cuts(seq, length, 200, 40), 0.0, 0
    for e in ends:
        got += cost[e] + S.IMBALANCE * (((e - at if at else e - 40) - share) / share) ** 2
        at = e
    assert got == pytest.approx(want)


def test_cuts_at_a_stop_mark_in_reach():
    seq = "ACDEFGHIKL" * 90 + "*" + "MNPQRSTVWY" * 60
    assert S.cuts(seq, 1500, 1022, 254)[0] == 900


def test_rows(spark):
    rows = [(1, "A" * 1022, "x"), (2, "A" * 1023, "x"), (2, "A" * 1023, "x"), (3, None, "x"), (4, "", "x"), (5, "a1-\n" * 1100, "x"), (6, "ACDEFGHIKL" * 30_000, "x")]
    df = spark.createDataFrame(rows, "rec_id long, seq string, k string").withColumnRenamed("k", "piece")
    got = S.split_oversized(df, "rec_id", "seq").collect()
    assert {r.rec_id for r in got} == {2, 5, 6}
    assert sum(r.piece_no == 0 for r in got if r.rec_id == 2) == 2
    assert all(len(r.piece) == r.end - r.start <= 1022 for r in got)
    assert S.split_oversized(df.limit(0), "rec_id", "seq").count() == 0
