"""Weights brought to a common scale, over the whole graph or the candidates of each source."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skew
from ..runtime import cut

TINY = 1e-12
SALTS = 16


def clip01(x: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def _minmax(x: Column, low: Column, high: Column) -> Column:
    return F.when(high <= low + TINY, F.lit(0.0)).otherwise((x - low) / (high - low))


def over_graph(edges: DataFrame, mode: str) -> DataFrame:
    """``w`` by ``mode``: minmax (0 everywhere where all weights are equal), clip01 or raw.

    The extremes are one row of partial results, attached without a shuffle of the edges.
    """
    if mode == "raw":
        return edges
    if mode == "clip01":
        return edges.withColumn("w", clip01(F.col("w")))
    if mode == "minmax":
        ends = edges.agg(F.min("w").alias("__low"), F.max("w").alias("__high"))
        scaled = edges.join(F.broadcast(ends), how="cross")  # one row
        return scaled.withColumn("w", _minmax(F.col("w"), F.col("__low"), F.col("__high"))).drop("__low", "__high")
    raise ValueError(f"no such normalisation: {mode}")


def _statistics(edges: DataFrame, source: str, hot: list, what: dict[str, Column]) -> DataFrame:
    """``edges`` with aggregates of each source, joined back; edges of ``hot`` sources are spread over tasks."""
    stats = skew.replicate(edges.groupBy(source).agg(*(c.alias(n) for n, c in what.items())), source, hot, SALTS, "__salt")
    by = skew.salt(source, F.monotonically_increasing_id(), hot, SALTS)
    return edges.withColumn("__salt", by).join(stats, [source, "__salt"]).drop("__salt")


def over_source(edges: DataFrame, mode: str, source: str = "src", temperature: float = 1.0) -> DataFrame:
    """``w`` by ``mode`` over the candidates of each source: minmax, sigmoid_z, softmax, clip01 or raw.

    ``sigmoid_z`` is the logistic of the z-score (population deviation) over ``temperature``;
    ``softmax`` is shifted by the greatest weight.
    """
    w, t = F.col("w"), max(temperature, TINY)
    if mode in ("raw", "clip01"):
        return over_graph(edges, mode)
    if mode not in ("minmax", "sigmoid_z", "softmax"):
        raise ValueError(f"no such normalisation: {mode}")
    edges = cut(edges)  # read for hot sources, for the statistics and for what they are joined to
    hot = skew.hot_keys(edges, source)
    if mode == "minmax":
        told = _statistics(edges, source, hot, {"__low": F.min("w"), "__high": F.max("w")})
        return told.withColumn("w", _minmax(w, F.col("__low"), F.col("__high"))).drop("__low", "__high")
    if mode == "sigmoid_z":
        told = _statistics(edges, source, hot, {"__mean": F.avg("w"), "__sd": F.stddev_pop("w")})
        z = (w - F.col("__mean")) / (F.col("__sd") + TINY)
        return told.withColumn("w", 1 / (1 + F.exp(-z / t))).drop("__mean", "__sd")
    top = _statistics(edges, source, hot, {"__top": F.max("w")}).withColumn("__e", F.exp((w - F.col("__top")) / t)).drop("__top")
    told = _statistics(top, source, hot, {"__sum": F.sum("__e")})
    return told.withColumn("w", F.col("__e") / (F.col("__sum") + TINY)).drop("__e", "__sum")


def gate(p: Column, beta: float, form: str) -> Column:
    """What a signal ``p`` multiplies a prior weight by: exp(beta p) or 1 + beta p."""
    if form == "exp":
        return F.exp(beta * p)
    if form == "linear":
        return 1 + beta * p
    raise ValueError(f"no such gate: {form}")


def top_per_source(edges: DataFrame, m: int, source: str = "src", target: str = "dst", salts: int = SALTS) -> DataFrame:
    """The ``m`` heaviest edges of each source, the smaller target first among equals, with ``rank``.

    Sources are ranked in ``salts`` subgroups by target first, so that a source with a great share of
    the edges is no single task.
    """
    order = [F.desc("w"), F.asc(target)]
    part = edges.withColumn("__salt", F.pmod(F.xxhash64(target), F.lit(salts)))
    part = part.withColumn("__r", F.row_number().over(Window.partitionBy(source, "__salt").orderBy(*order))).where(F.col("__r") <= m)
    return part.drop("__r", "__salt").withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("rank") <= m)
