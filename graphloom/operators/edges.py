"""Weighted edge lists: ``u, v, w`` with a double ``w``; canonical edges have ``u < v``.

NULL ids and NaN weights never name an edge: ``clean`` drops them, and every composite of this
package calls it first. Other columns are ignored. Empty inputs give empty results.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, what: str, least: int = 1) -> DataFrame:
    """``df``, if it has ``least`` rows or more; otherwise a ValueError that says ``what`` is missing. Reads ``least`` rows."""
    if df.limit(least).count() < least:
        raise ValueError(f"fewer than {least} {what}")
    return df


def clean(edges: DataFrame) -> DataFrame:
    """Edges with two different ids and a weight that is a number."""
    return edges.select("u", "v", F.col("w").cast("double").alias("w")).where("u <> v and w is not null and not isnan(w)")


def canonical_pairs(edges: DataFrame) -> DataFrame:
    """The smaller id first; other columns are kept."""
    return edges.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def merge_max(edges: DataFrame) -> DataFrame:
    """The greatest weight of each undirected pair; partial maxima are taken before the shuffle."""
    return canonical_pairs(clean(edges)).groupBy("u", "v").agg(F.max("w").alias("w"))


def merge_sum(edges: DataFrame) -> DataFrame:
    return canonical_pairs(clean(edges)).groupBy("u", "v").agg(F.sum("w").alias("w"))


def last_of_pair(edges: DataFrame, order: str) -> DataFrame:
    """The weight of the row that comes last by ``order`` for each undirected pair."""
    rows = edges.select("u", "v", F.col("w").cast("double").alias("w"), order).where("u <> v and w is not null and not isnan(w)")
    last = F.max(F.struct(F.col(order).alias("o"), "w"))
    return canonical_pairs(rows).groupBy("u", "v").agg(last["w"].alias("w"))


def distinct_pairs(edges: DataFrame) -> DataFrame:
    """Undirected pairs without weight, once each."""
    return canonical_pairs(edges.select("u", "v").where("u <> v")).distinct()


def positive(edges: DataFrame, least: float = 0.0) -> DataFrame:
    return edges.where((F.col("w") > least) & ~F.isnan("w"))


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids(id)``."""
    known = ids.select("id").where("id is not null").distinct()
    for end in ("u", "v"):
        edges = edges.join(known.withColumnRenamed("id", end), end, "left_semi")
    return edges.select("u", "v", *[c for c in edges.columns if c not in ("u", "v")])


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge as ``src, dst, w`` in either direction; read once, not twice."""
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(*rest, F.explode(ends).alias("e")).select(*rest, "e.src", "e.dst")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree, strength)``: edges of each node and the sum of their weights."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("id"), "w")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def six_digits(w: Column) -> Column:
    """``w`` as the interchange format rounds it, ``%.6g``."""
    return F.format_string("%.6g", w).cast("double")
