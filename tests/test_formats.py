"""Readers and writers that no query with SQL goes through, and their odd cases."""

import pytest
from graphloom.operators import edges as E
from graphloom.operators import metrics, sequences, supervised
from graphloom.sources import formats


def test_files_follow_by_name(spark, tmp_path):
    """The last file by name decides, though it is the smallest; lines count in their order."""
    (tmp_path / "a.tsv").write_text("x\ty\t1\n" + "p\tq\t1\n" * 2000 + "p\tq\t7\n")
    (tmp_path / "b.tsv").write_text("x\ty\t2\nx\ty\t3\n" + "r\ts\t1\n" * 500)
    (tmp_path / "c.tsv").write_text("y\tx\t0.5\n")
    rows = formats.read_edges(spark, str(tmp_path / "*.tsv"))
    got = {(r.u, r.v): r.w for r in E.last_of_pair(rows, "line_no").collect()}
    assert got == {("x", "y"): 0.5, ("p", "q"): 7.0, ("r", "s"): 1.0}


def test_folder_of_graphs(spark, tmp_path):
    (tmp_path / "one.tsv").write_text("a\tb\t0.5\nb\ta\t0.7\na\tc\t0.1\na\td\t2\na\ta\t3\nbad\nu\tv\tw\na\tb\tnan\n")
    (tmp_path / "two.tsv").write_text("a\tb\t0.2\n")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    got = {tuple(r) for r in formats.read_graphs(spark, str(tmp_path / "*.tsv"), nodes, 0.1).select("graph", "u", "v", "w").collect()}
    assert got == {("one", "a", "b", 0.7), ("two", "a", "b", 0.2)}


def test_lists_lengths_parts(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, "x"), ("a", 1, "y")], "id string, n int, split string")
    formats.write_lines(df, "n", str(tmp_path / "n"), [df["id"]])
    assert [r.length for r in formats.read_lengths(spark, str(tmp_path / "n")).orderBy("pos").collect()] == [1.0, 2.0]
    formats.write_parts(df, "split", str(tmp_path / "p"))
    assert (tmp_path / "p" / "split=x").exists() and spark.read.parquet(str(tmp_path / "p")).count() == 2
    formats.write_summary_json(df.withColumnRenamed("split", "graph").selectExpr("graph", "n", "cast(null as double) auprc"), str(tmp_path / "j"))
    assert '"auprc":null' in next((tmp_path / "j" / "graph=x").glob("part-*")).read_text()


def test_guards(spark):
    none = spark.createDataFrame([], "u string, v string, w double")
    vectors = spark.createDataFrame([("a", [1.0])], "id string, vector array<double>")
    with pytest.raises(ValueError, match="positive pairs"):
        supervised.labelled(none, vectors)
    with pytest.raises(ValueError, match="2 nodes"):
        supervised.labelled(spark.createDataFrame([("a", "b", 1.0)], "u string, v string, w double"), vectors)
    records = spark.createDataFrame([("a", "MK")], "id string, seq string")
    listed = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sequences.required(listed.where("id = 'a'"), records).count() == 1
    with pytest.raises(Exception, match="no sequence: b"):
        sequences.required(listed, records).collect()


def test_summaries(spark):
    df = spark.createDataFrame([("x.tsv", 0.1), ("y", None), ("z.tsv", 0.3)], "graph string, auprc double")
    assert [r.graph for r in metrics.by_metric(metrics.named(df, {"x": "first"}), "auprc").collect()] == ["z", "first", "y"]
    assert metrics.by_metric(df, "recall").count() == 3 and metrics.named(df, {}).where("graph = 'x'").count() == 1


def test_model_is_kept(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(1.0, Vectors.dense([1.0, 0.2])), (0.0, Vectors.dense([-1.0, 0.1])), (1.0, Vectors.dense([0.8, 0.0]))], ["y", "x"])
    model = supervised.train(rows, rows)
    supervised.save(model, str(tmp_path / "m"))
    assert supervised.load(str(tmp_path / "m")).coefficients == model.coefficients
