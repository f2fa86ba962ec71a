"""The text formats between stages: edge lists, id lists, seeds, labels, summaries and FASTA.

Readers differ in what they do with bad lines: lenient ones skip them, strict ones fail on a weight
that is no number. Lines that are too short and self-loops are always skipped.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E

_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


#: Where a line stands: files by path, then the split of the file, then the order of reading. Compares as the lines follow.
_PLACE = "struct(_metadata.file_path as file, _metadata.file_block_start as split, monotonically_increasing_id() as line)"
#: The stem of a file's name; of a folder of part files, as Spark writes them, the folder's.
_STEM = r"([^/]+?)(?:\.[A-Za-z0-9]+)?(?:/part-[^/]*)?$"


def _lines(spark: SparkSession, path: str | list[str], trim: bool) -> DataFrame:
    """Lines with ``line_no``, which orders them by file name and place in the file, and ``part``, the file's stem; an empty match fails in Spark."""
    rows = spark.read.text(path).select("value", F.expr(_PLACE).alias("line_no"))
    rows = rows.withColumn("part", F.regexp_extract("line_no.file", _STEM, 1))
    return rows.withColumn("value", F.trim("value")) if trim else rows


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def read_edges(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """``(u, v, w, part, line_no)`` of headerless lines of three columns.

    Lenient: a weight that is no number skips the line, a header among them. Strict: it fails.
    """
    f = F.split("value", "\t")
    rows = _lines(spark, path, trim=strict).where(F.size(f) >= 3).select(f[0].alias("u"), f[1].alias("v"), f[2].alias("t"), "part", "line_no").where("u <> v")
    if strict:
        told = F.raise_error(F.concat(F.lit("no number: "), "t")).cast("double")
        return rows.select("u", "v", F.coalesce(_number(F.col("t")), told).alias("w"), "part", "line_no")
    return rows.select("u", "v", _number(F.col("t")).alias("w"), "part", "line_no").where("w is not null")


def read_graphs(spark: SparkSession, path: str | list[str], nodes: DataFrame | None = None, min_w: float = 0.0) -> DataFrame:
    """``(graph, u, v, w)`` of a folder of edge files, one graph a file, named by its stem.

    Lenient lines; ``nodes(id)``: only edges with both ends among them; only weights above ``min_w``. Of an
    undirected pair in a file the greatest weight counts.
    """
    rows = read_edges(spark, path).select(F.col("part").alias("graph"), "u", "v", "w").where((F.col("w") > min_w) & ~F.isnan("w"))
    if nodes is not None:
        rows = E.within(rows, nodes)
    return E.canonical_pairs(rows).groupBy("graph", "u", "v").agg(F.max("w").alias("w"))


def read_pairs(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """``(u, v)`` of lines of two columns or more; with ``header``, lines whose first column begins with node are skipped."""
    f = F.split("value", "\t")
    rows = _lines(spark, path, trim=True).where(F.size(f) >= 2).select(f[0].alias("u"), f[1].alias("v")).where("u <> v")
    return rows.where(~F.lower("u").startswith("node")) if header else rows


def read_ids(spark: SparkSession, path: str, first_token: bool = False) -> DataFrame:
    """``(id, pos)`` of lines that are not blank, in order; ``first_token`` takes what is before the first blank."""
    rows = _lines(spark, path, trim=True).where("value <> ''")
    name = F.split("value", r"\s+")[0] if first_token else F.col("value")
    return rows.select(name.alias("id"), F.col("line_no").alias("pos"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """``(id, weight)``; a weight that is missing or no number is 1."""
    f = F.split("value", "\t")
    rows = _lines(spark, path, trim=False).select(F.trim(f[0]).alias("id"), F.get(f, 1).alias("t")).where("id <> ''")
    return rows.select("id", F.coalesce(_number(F.col("t")), F.lit(1.0)).alias("weight"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(id, value, line_no)``; lines without a number are skipped."""
    f = F.split("value", "\t")
    rows = _lines(spark, path, trim=False).where(F.size(f) >= 2).select(F.trim(f[0]).alias("id"), _number(f[1]).alias("value"), "line_no")
    return rows.where("id <> '' and value is not null")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, trim=True).where("value <> ''").select(F.col("value").cast("double").alias("length"), F.col("line_no").alias("pos"))


def read_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A TSV with a header, all columns as text; missing ones fail."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_fasta(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """``(id, seq, record)``: the first token of each header and its body without white space.

    Records may span splits of a file; headers without an id are skipped, those without a body only
    unless ``keep_empty``. Repeated headers come out once each: ``sequences.last_of_id`` takes the last.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("record", F.monotonically_increasing_id())
    text = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "^>", "")
    parts = F.split(text, "\n", 2)
    header = F.split(F.trim(parts[0]), r"\s+")[0]
    body = F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s", "")
    out = rows.select(header.alias("id"), body.alias("seq"), "record").where("id <> ''")
    return out if keep_empty else out.where("seq <> ''")


def write_edges(edges: DataFrame, path: str) -> None:
    """Lines of u, v and the weight with six significant digits, sorted by pair."""
    line = F.concat_ws("\t", "u", "v", F.format_string("%.6g", F.col("w")))
    edges.orderBy("u", "v").select(line.alias("value")).write.mode("overwrite").text(path)


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    from ..operators.sequences import wrapped

    text = F.concat(F.lit(">"), "id", F.lit("\n"), wrapped(F.col("seq"), width))
    records.select(text.alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, column: str, path: str, order: list[Column] | None = None) -> None:
    rows = df.orderBy(*order) if order else df
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_parts(df: DataFrame, by: str, path: str) -> None:
    """Parquet with one folder for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_summary(summaries: DataFrame, path: str) -> None:
    """A TSV with a header in the order of ``place``; missing values are empty."""
    summaries.orderBy("place").write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="")


def write_summary_json(summaries: DataFrame, path: str) -> None:
    """A folder for each graph with its summary, one JSON object; missing values are null."""
    summaries.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("graph").json(path)
