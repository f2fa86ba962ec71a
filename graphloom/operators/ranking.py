"""Positions in a global order without a single task that holds it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, partitions


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """``df`` with ``rank`` in the ``order`` within each ``by``, and the running sum of ``total`` as ``running``.

    Rows are range-partitioned by ``by`` and ``order``, ranked within their part, and moved on by
    what the parts before hold; the parts' sums are a few rows. ``order`` has to be total,
    so that parts don't depend on how equal rows fall; NULLs are ordered as Spark orders them.
    """
    by = by or []
    n = partitions(df.sparkSession)
    amount = F.col(total).cast("double") if total else F.lit(0.0)
    parts = df.withColumn("__y", amount).repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id())
    parts = cut(parts)  # a second evaluation might sample other bounds
    here = Window.partitionBy("__part", *by).orderBy(*order)
    sums = parts.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__s"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("__part", *by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s0"))
    out = parts.withColumns({"rank": F.row_number().over(here), "running": F.sum("__y").over(here.rowsBetween(Window.unboundedPreceding, 0))})
    same = out["__part"] == shift["__part"]
    for c in by:
        same = same & out[c].eqNullSafe(shift[c])
    out = out.join(F.broadcast(shift), same).select(
        *[out[c] for c in df.columns], (out["rank"] + shift["__n0"]).alias("rank"), (out["running"] + shift["__s0"]).alias("running")
    )
    return out if total else out.drop("running")
