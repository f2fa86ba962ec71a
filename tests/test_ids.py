from pyspark.sql import functions as F

from graphloom.functions import ids, skew

A, B = "7701.FMPP00000001234", "7715.FMPP00000000007"


def test_spellings(spark):
    same = [A, A.lower(), "FMPP00000001234", f"  {A} ", f"{A}.3", "fmpp00000001234.11\t", "7701.Fmpp00000001234"]
    other = [B, "7701.FMPP00000001235"]
    bad = ["7701.FMPP0000001234", "7701FMPP00000001234x", "7701.FMPP000000012345", "7701.FMPG00000001234", "node1", "", " \t", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(same + other + bad)], "i int, t string")
    got = [r.c for r in df.orderBy("i").select(ids.canonical(F.col("t")).alias("c")).collect()]
    assert got == [A] * len(same) + [B, "7701.FMPP00000001235"] + [None] * len(bad)
    blank = [r.b for r in df.orderBy("i").select(ids.is_blank(F.col("t")).alias("b")).collect()]
    assert blank[-3:] == [True] * 3 and not any(blank[:-3])


def test_line_ends(spark):
    df = spark.createDataFrame([(A + end,) for end in ("", "\n", "\r\n", "\r", "\u0085", "\u2028", " \n")], "t string")
    got = {r.t: r.c for r in df.select("t", ids.canonical(F.col("t")).alias("c")).collect()}
    assert {got[A + end] for end in ("", "\n", "\r\n", "\r", " \n")} == {A}
    assert set(got.values()) <= {A, None}


def test_former_ids(spark, monkeypatch):
    rows = [(A, "fmpp00000700001"), (A, None), (B, A), (B, "FMPP00000700001"), (None, "FMPP00000700002"), ("bad", "FMPP00000700003")]
    nodes = spark.createDataFrame([(*r, 1) for r in rows], "id string, alias string, name int")
    former = ids.former_ids(nodes)
    assert {tuple(r) for r in former.collect()} == {("7701.FMPP00000700001", A)}
    df = spark.createDataFrame([("7701.FMPP00000700001", B)] * 9 + [(B, None), (None, "7701.FMPP00000700001")], "u string, v string")
    want = sorted(map(str, [(A, B)] * 9 + [(B, None), (None, A)]))
    assert sorted(str(tuple(r)) for r in ids.resolve(df, ["u", "v"], former).collect()) == want
    monkeypatch.setattr(ids, "BROADCAST_ROWS", 0)
    assert sorted(str(tuple(r)) for r in ids.resolve(df, ["u", "v"], former).collect()) == want


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("a", 1), (None, 2)], "k string, n int")
    right = spark.createDataFrame([("hot", "x"), ("a", "y"), ("b", "z")], "k string, t string")
    hot = skew.hot_keys(left, "k", 4, 1)
    assert hot == ["hot"] and skew.hot_keys(left, "k", 4) == []
    got = left.withColumn("salt", skew.salt("k", F.col("n"), hot, 7)).join(skew.replicate(right, "k", hot, 7), ["k", "salt"], "left")
    assert got.groupBy("k", "t").count().orderBy("count", "k").collect() == left.join(right, "k", "left").groupBy("k", "t").count().orderBy("count", "k").collect()
