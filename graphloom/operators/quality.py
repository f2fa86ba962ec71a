"""Checks of embeddings, over all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .vectors import exact_neighbours, finite, norm

QUANTILES = [0.0, 0.01, 0.5, 0.99, 1.0]


def finite_report(df: DataFrame) -> DataFrame:
    """Counts of ``id, vector`` rows: all, NULL, with elements that are no finite numbers, and near zero."""
    sound = finite(F.col("vector"))
    small = F.when(sound, norm(F.col("vector")) < 1e-6).otherwise(False)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("vector").isNull()).alias("n_null"),
        F.count_if(~sound).alias("n_not_finite"),
        F.count_if(small).alias("n_near_zero"),
    )


def quantiles(df: DataFrame, column: str, at: list[float] | None = None) -> DataFrame:
    """``(q, value)``, linearly interpolated, without one task that holds all values.

    Values are ranked in parts; each quantile takes the two values at its place.
    """
    at = at or QUANTILES
    rows = ranked(df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").withColumn("i", F.monotonically_increasing_id()), [F.asc("x"), F.asc("i")])
    n = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select(F.explode(F.array(*map(F.lit, at))).alias("q"), (F.col("n") - 1).alias("top")).withColumn("place", F.col("q") * F.col("top"))
    wanted = wanted.select("q", "place", F.explode(F.array(F.floor("place"), F.floor("place") + 1)).alias("at"))
    share = F.greatest(F.lit(0.0), 1 - F.abs(F.col("place") - F.col("at")))
    met = rows.join(F.broadcast(wanted.where(share > 0)), F.col("rank") - 1 == F.col("at"))  # two rows per quantile
    return met.groupBy("q").agg(F.sum(F.col("x") * share).alias("value"))


def norms(df: DataFrame) -> DataFrame:
    return df.where(finite(F.col("vector"))).select("id", norm(F.col("vector")).alias("norm"))


def top_similarities(queries: DataFrame, base: DataFrame, top: int = 5) -> DataFrame:
    """``(id, first, last)``: the highest and the ``top``-th highest cosine of each query."""
    near = exact_neighbours(queries, base, top)
    return near.groupBy(F.col("src").alias("id")).agg(F.max("w").alias("first"), F.max(F.when(F.col("rank") == top, F.col("w"))).alias("last"))


def rank_correlation(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Pearson correlation of the ordinal ranks of two columns; of ties the smaller ``key`` comes first."""
    rows = df.select(F.col(key).alias("k"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    first = ranked(rows, [F.asc("a"), F.asc("k")]).withColumnRenamed("rank", "ra")
    both = ranked(first, [F.asc("b"), F.asc("k")])
    return both.agg(F.corr("ra", "rank").alias("correlation"), F.count(F.lit(1)).alias("n"))
