"""The N highest-scoring items of every group, by two-stage salted ranking."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def top_items(df: DataFrame, group: str, item: str, score: str, n: int, salts: int = SALTS) -> DataFrame:
    """``(group, item, score, rank)`` of the up to ``n`` items of highest score in each group.

    An item that a group holds several times counts once, with its highest score. Rows without
    group, item or score, and scores that are NaN, don't count. Of equal scores the item that is
    smaller comes first. Each group is hashed by item into ``salts`` subgroups; each subgroup
    keeps its first ``n`` and only those meet in the second ranking, so that no task ranks
    a whole group: a task of the second stage holds ``salts * n`` rows of a group at most.
    Other columns are ignored. An empty input gives an empty result.
    """
    g, i, s = F.col(f"`{group}`"), F.col(f"`{item}`"), F.col(f"`{score}`").cast("double")
    best = (
        df.select(g.alias("g"), i.alias("i"), s.alias("s"))
        .where("g is not null and i is not null and s is not null and not isnan(s)")
        .withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
        .groupBy("g", "salt", "i")
        .agg(F.max("s").alias("s"))
    )
    survivors = _first(best, ["g", "salt"], n).drop("rank")
    return _first(survivors, ["g"], n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")


def _first(df: DataFrame, by: list[str], n: int) -> DataFrame:
    rank: Column = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("s"), "i"))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
