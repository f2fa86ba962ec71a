"""Spreading hot keys over several tasks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A key with fewer rows is no burden to a task, whatever its share.
LEAST_ROWS = 10_000


def hot_keys(df: DataFrame, key: str, share: int = 128, least: int = LEAST_ROWS) -> list:
    """Keys that hold more than one row in ``share``, and ``least`` rows: fewer than ``share`` of them, whatever the size."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    top = counts.orderBy(F.desc("__n")).limit(share).collect()
    total = df.count() if top else 0
    return [r[0] for r in top if r["__n"] * share > total]


def salt(key: str, by: Column, hot: list, salts: int) -> Column:
    """0 for an ordinary key, one of ``salts`` numbers drawn from ``by`` for a hot one or NULL (NULL meets no key)."""
    spread = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    return F.when(spread, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")


def replicate(df: DataFrame, key: str, hot: list, salts: int, name: str = "salt") -> DataFrame:
    """Rows of hot keys once for each salt, other rows with salt 0."""
    if not hot:
        return df.withColumn(name, F.lit(0))
    reach = F.when(F.col(key).isin(hot), F.lit(salts - 1)).otherwise(0)
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), reach)))


def semi_join(df: DataFrame, keys: DataFrame, key: str, by: Column, hot: list, salts: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys``, with those of hot keys spread by ``by``."""
    known = replicate(keys.select(key).distinct(), key, hot, salts, "__salt")
    return df.withColumn("__salt", salt(key, by, hot, salts)).join(known, [key, "__salt"], "left_semi").drop("__salt")
