"""Vectors as ``array<float>`` columns, and the exact search of a query set against all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .normalize import top_per_source

TINY = 1e-12
#: Queries that one task multiplies with its rows at least and at most, and rows at most.
LEAST_QUERIES, QUERY_BLOCK, MOST_BLOCK = 512, 4096, 65_536
#: Numbers of a block of products at most: 64 MB.
_PRODUCTS = 1 << 23
#: Cosines that agree in so many digits are ties: products of equal vectors may differ in the last bits.
DIGITS = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a / (|a| + 1e-12)`` in double precision."""
    size = norm(a) + TINY
    return F.transform(a, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def finite(a: Column) -> Column:
    """Whether all elements are finite numbers; NULL for a NULL array."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def exact_neighbours(queries: DataFrame, base: DataFrame, m: int, size: int | None = None) -> DataFrame:
    """``(src, dst, w, rank)``: for each query the ``m`` rows of ``base`` of highest cosine, itself left out.

    Both have ``id, vector``. Vectors that are NULL, not finite or not ``size`` long never match; by
    default ``size`` is the commonest length among the queries, the smaller of equally common
    ones. Blocks of queries meet blocks of ``base`` as matrix products; each pair of blocks keeps ``m`` rows per query,
    which are ranked last. The number of blocks comes from counts, so that no block grows with
    the tables. Of equal cosines the smaller id comes first, however many there are. The query
    set is the stated one of the caller; no pair of rows is written that is not among a block's best.
    """
    sound = lambda df: df.select("id", "vector").where(F.col("vector").isNotNull() & finite(F.col("vector")))
    queries, base = cut(sound(queries)), cut(sound(base))
    kind = queries.schema["id"].dataType.simpleString()
    if size is None:
        # One row per length; the first of them.
        common = queries.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size = common["size"] if common else 0
    queries, base = (df.where(F.size("vector") == size) for df in (queries, base))
    n, cores = queries.count(), base.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-base.count() // MOST_BLOCK))
    # Where there are cores to spare, queries are divided further, not the rows: each block of rows keeps m of them for every query.
    blocks = max(1, -(-n // QUERY_BLOCK), min(cores // parts, n // LEAST_QUERIES))
    left = queries.select(F.col("id").alias("src"), F.col("vector").alias("x")).withColumn("q", F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = base.select(F.col("id").alias("dst"), F.col("vector").alias("y")).withColumn("b", F.pmod(F.xxhash64("dst"), F.lit(parts)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"src": a["src"].iloc[:0], "dst": b["dst"].iloc[:0], "w": np.empty(0)})]
        if len(a) and len(b):
            b = b.sort_values("dst", ignore_index=True)
            x, y, src, dst = _rows(a["x"]), _rows(b["y"]), a["src"].to_numpy(), b["dst"].to_numpy()
            step = max(1, _PRODUCTS // len(dst))
            for at in range(0, len(x), step):
                similar = np.round(x[at : at + step] @ y.T, DIGITS)
                similar[src[at : at + step, None] == dst[None, :]] = -np.inf
                out.append(_block_best(similar, src[at : at + step], dst, m))
        return pd.concat(out)

    pairs = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(best, f"src {kind}, dst {kind}, w double")
    return cut(top_per_source(pairs, m))


def _block_best(similar: np.ndarray, src: np.ndarray, dst: np.ndarray, m: int) -> pd.DataFrame:
    """The ``m`` greatest of each row; of those that tie with the last, the first by ``dst``, which is sorted."""
    keep = min(m, len(dst))
    least = np.partition(similar, len(dst) - keep, axis=1)[:, len(dst) - keep]
    row, column = np.nonzero((similar >= least[:, None]) & (similar > -np.inf))
    value = similar[row, column]
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < m
    return pd.DataFrame({"src": src[row[first]], "dst": dst[column[first]], "w": value[first]})


def _rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + TINY)

