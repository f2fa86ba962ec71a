import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import quality, scorers, sequences
from graphloom.sources import formats


def test_windows(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abcd"), (3, ""), (4, None)], "id int, seq string")
    out = [(r.id, r.no, r.start, r.window) for r in sequences.windows(df, "id", "seq", 4, 3).orderBy("id", "no").collect()]
    assert out == [(1, 0, 0, "abcd"), (1, 1, 3, "defg"), (1, 2, 6, "ghij"), (2, 0, 0, "abcd")]


def test_text_forms(spark):
    df = spark.createDataFrame([("ABCDE", "FG")], "a string, b string")
    r = df.select(sequences.linked(F.col("a"), F.col("b"), 3), sequences.spaced(F.col("a")), sequences.wrapped(F.col("a"), 2), sequences.wrapped(F.col("b"), 2), sequences.length_bucket(F.col("a"), 2)).first()
    assert tuple(r) == ("ABCDEXXXFG", "A B C D E", "AB\nCD\nE", "FG", 4)


def test_formats(spark, tmp_path):
    p = tmp_path / "e.tsv"
    p.write_text("u\tv\tw\na\tb\t0.5\na\ta\t1\na\tb\nc\td\t1e-3\nx\ty\tbad\nx\ty\tnan\n")
    rows = {(r.u, r.v, str(r.w)) for r in formats.read_edges(spark, str(p)).collect()}
    assert rows == {("a", "b", "0.5"), ("c", "d", "0.001"), ("x", "y", "nan")}
    with pytest.raises(Exception, match="no number"):
        formats.read_edges(spark, str(p), strict=True).collect()
    s = tmp_path / "s.tsv"
    s.write_text("a\na\t2\nb\tx\nc\t-1\n\n")
    from graphloom.operators.diffusion import seed_vector

    assert {r.id: r.p for r in seed_vector(formats.read_seeds(spark, str(s))).collect()} == {"a": 0.75, "b": 0.25}
    i = tmp_path / "i.txt"
    i.write_text("b x\n\na\n")
    assert [r.id for r in formats.read_ids(spark, str(i), True).orderBy("pos").collect()] == ["b", "a"]
    n = tmp_path / "n.tsv"
    n.write_text("node1\tnode2\na\tb\na\na\ta\n")
    assert [tuple(r) for r in formats.read_pairs(spark, str(n)).collect()] == [("a", "b")]
    lab = tmp_path / "l.tsv"
    lab.write_text("a\t1\nb\tx\n c \t0\n")
    assert {(r.id, r.value) for r in formats.read_labels(spark, str(lab)).collect()} == {("a", 1.0), ("c", 0.0)}
    with pytest.raises(ValueError, match="auprc"):
        formats.read_table(spark, str(n), ["auprc"])


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a", "M" * 130), ("b", "ACD"), ("c", "K" * 60)]
    formats.write_fasta(spark.createDataFrame(rows, "id string, seq string"), str(tmp_path / "out"))
    back = formats.read_fasta(spark, str(tmp_path / "out"))
    assert {(r.id, r.seq) for r in back.collect()} == set(rows)
    f = tmp_path / "x.fa"
    f.write_text(">a one > two\r\nMK\r\nV\n>b\n>a\nQQ\n>\nZZ\n")
    assert [(r.id, r.seq) for r in formats.read_fasta(spark, str(f)).orderBy("record").collect()] == [("a", "MKV"), ("a", "QQ")]
    kept = formats.read_fasta(spark, str(f), keep_empty=True)
    assert {(r.id, r.seq) for r in sequences.last_of_id(kept, "record").collect()} == {("a", "QQ"), ("b", "")}


def test_edge_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 1 / 3), ("c", "d", 123456789.0)], "u string, v string, w double")
    formats.write_edges(df, str(tmp_path / "e"))
    back = formats.read_edges(spark, str(tmp_path / "e"))
    assert {(r.u, r.w) for r in back.collect()} == {("a", 0.333333), ("c", 1.23457e8)}


def test_quality(spark):
    x = np.random.default_rng(0).standard_normal(101)
    df = spark.createDataFrame([(i, float(v), [float(v), 0.0]) for i, v in enumerate(x)] + [(900, None, None), (901, float("nan"), [float("nan"), 1.0])], "id int, x double, vector array<double>")
    got = {r.q: r.value for r in quality.quantiles(df, "x").collect()}
    assert got == pytest.approx({q: np.quantile(x, q) for q in quality.QUANTILES})
    assert tuple(quality.finite_report(df).first()) == (103, 1, 1, 0)
    r = quality.rank_correlation(df.where("x is not null and not isnan(x)").withColumn("y", -F.col("x")), "id", "x", "y").first()
    assert r.correlation == pytest.approx(-1) and r.n == 101


def test_encoders(spark):
    df = spark.createDataFrame([(1, 0, "AAC"), (1, 1, "C"), (2, 0, "W")], "id int, no int, s string")
    out = sequences.mean_of_windows(df.select("id", scorers.composition_encoder(F.col("s")).alias("v")), "id", "v")
    got = {r.id: r.v for r in out.collect()}
    assert got[1][:2] == pytest.approx([1 / 3, 2 / 3]) and got[2][scorers.ALPHABET.index("W")] == 1
    j = df.select(scorers.jaccard(scorers.kmers(F.lit("ABCDE")), scorers.kmers(F.lit("BCDEF")))).first()[0]
    assert j == 0.5


def test_kmer_codes_tell_kmers_apart(spark):
    texts = ["ABCDEABC", "AB", "A", "ZZZZ", "BAB", "ABA", "AAB"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", scorers.kmers(F.col("s")).alias("a"), scorers.kmer_codes(F.col("s")).alias("b")).collect()
    code = lambda x: sum((ord(c) - 64) * 27 ** (2 - i) for i, c in enumerate(x))
    assert all([code(x) for x in r.a] == r.b for r in rows) and len({tuple(r.b) for r in rows}) == len(texts)
