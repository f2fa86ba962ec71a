import random

from graphloom.llm.top_items import top_items


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s) and s == s:
            best[g, i] = max(s, best.get((g, i), s))
    out = set()
    for g in {g for g, _ in best}:
        items = sorted((-s, i) for (h, i), s in best.items() if h == g)
        out |= {(g, i, -s, k + 1) for k, (s, i) in enumerate(items[:n])}
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice("abcdef"), f"i{rng.randrange(90)}", rng.choice([0.0, 0.5, 1.0, -1.0, float("nan"), None, rng.random()])) for _ in range(3000)]
    rows += [(None, "i", 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "u string, v string, w double, salt string, rank int")
    got = {(r.u, r.v, r.w, r["rank"]) for r in top_items(df, "u", "v", "w", 5).collect()}
    assert got == brute(rows, 5)
    assert got == {(r.u, r.v, r.w, r["rank"]) for r in top_items(df, "u", "v", "w", 5, salts=1).collect()}
    assert top_items(df.limit(0), "u", "v", "w", 5).count() == 0
