import pytest
from graphloom.llm.split_overlap import matches, overlapping_rows

TRAIN = [(1, "a b"), (2, "a b"), (3, "c d e f"), (4, None), (5, ""), (6, "xa b")]
EVAL = [(10, "a b", "val", "s"), (11, "c d", "test", None), (12, "d e f g", "test", "t"), (13, None, "val", "s"), (14, "a b", "val", "s"), (15, "q", "val", "s")]


def frames(spark):
    return spark.createDataFrame([(*r, 0) for r in TRAIN], "id long, text string, shard int"), spark.createDataFrame([(*r, "z") for r in EVAL], "id long, text string, split string, source string, covered string")


@pytest.mark.parametrize("shard", [1, 20, 1000])
def test_coverage(spark, shard):
    train, evaluation = frames(spark)
    texts = evaluation.selectExpr("id text_no", "text").where("id <> 14")
    got = {(r.training_id, r.text_no): r.covered for r in matches(train, texts, 2, 0.1, shard).collect()}
    assert got == {(1, 10): 1.0, (2, 10): 1.0, (3, 11): 1.0, (3, 12): 0.75}


def test_near_same_and_intervals(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w50", "other")
    train = spark.createDataFrame([(1, near), (2, f"x {text} y"), (3, "w1 w2 w3 w4 w5 w5 w6 w7 w8 w9"), (4, "w1 " * 50_000 + text)], "id long, text string")
    evaluation = spark.createDataFrame([(9, text, "val", "s")], "id long, text string, split string, source string")
    got = {r.training_id: round(r.covered, 6) for r in overlapping_rows(train, evaluation, 5, 0.05).collect()}
    assert got == {1: 0.99, 2: 1.0, 3: 0.09, 4: 1.0}


def test_rows(spark):
    train, evaluation = frames(spark)
    got = {(r.training_id, r.evaluation_id, r.split, r.source) for r in overlapping_rows(train, evaluation, 2, shard=20).collect()}
    assert got == {(t, e, "val", "s") for t in (1, 2) for e in (10, 14)} | {(3, 11, "test", None)}
    assert overlapping_rows(train.limit(0), evaluation, 2).count() == 0
    assert overlapping_rows(train, evaluation.limit(0), 2).count() == 0
