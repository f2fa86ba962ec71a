"""Train, validation and test parts of a graph, and negative pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..runtime import cut
from . import edges as E
from .ranking import ranked

PARTS = ("train", "val", "test")


def shuffled(seed: int, *keys: str) -> Column:
    """A value that puts rows into a random order, the same for the same keys and seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def _part(rank: Column, n: Column, train: float, val: float) -> Column:
    t, v = F.floor(n * train), F.floor(n * val)
    return F.when(rank <= t, "train").when(rank <= t + v, "val").otherwise("test")


def edge_split(edges: DataFrame, seed: int = 0, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """``(u, v, split)`` of the distinct undirected pairs; their nodes may occur in several parts."""
    pairs = E.distinct_pairs(edges).withColumn("__h", shuffled(seed, "u", "v"))
    n = pairs.agg(F.count(F.lit(1)).alias("__n"))  # one row
    rows = ranked(pairs, [F.asc("__h"), F.asc("u"), F.asc("v")]).join(F.broadcast(n), how="cross")
    return rows.select("u", "v", _part(F.col("rank"), F.col("__n"), train, val).alias("split"))


def node_split(edges: DataFrame, seed: int = 0, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """``(u, v, split)`` of the pairs with both ends in one part; edges between parts are left out."""
    pairs = E.distinct_pairs(edges)
    nodes = E.endpoints(pairs).withColumn("__h", shuffled(seed, "id"))
    n = nodes.agg(F.count(F.lit(1)).alias("__n"))  # one row
    rows = ranked(nodes, [F.asc("__h"), F.asc("id")]).join(F.broadcast(n), how="cross")
    parts = rows.select("id", _part(F.col("rank"), F.col("__n"), train, val).alias("split"))
    a, b = (parts.select(F.col("id").alias(end), F.col("split").alias(f"__{end}")) for end in ("u", "v"))
    return pairs.join(a, "u").join(b, "v").where("__u = __v").select("u", "v", F.col("__u").alias("split"))


def negatives(edges: DataFrame, ratio: float = 1.0, seed: int = 0, tries: int = 4, most: int = 48) -> DataFrame:
    """``(u, v)`` pairs that are no edges, ``ratio`` times as many, with ends drawn by degree.

    Each end of each edge is a draw of its node, so that a shuffled pairing of all ends draws by
    degree without a table of weights: the ends are put in two random orders, and the n-th of one meets
    the n-th of the other. Self-loops, edges and repeated pairs are rejected. ``tries`` pairings mostly give
    more than enough; as long as they don't, as many more follow, up to ``most``. Fewer pairs come out only
    where those don't hold enough either, as in a graph that is nearly complete.
    """
    pairs = cut(E.distinct_pairs(edges))
    ends = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("id"))
    wanted, drawn = int(pairs.count() * ratio), None
    for k in range(most):
        left = ranked(ends.withColumn("__h", shuffled(seed + 2 * k, "id", "u", "v")), [F.asc("__h"), F.asc("id"), F.asc("u"), F.asc("v")])
        right = ranked(ends.withColumn("__h", shuffled(seed + 2 * k + 1, "id", "u", "v")), [F.asc("__h"), F.asc("id"), F.asc("u"), F.asc("v")])
        met = left.select("rank", F.col("id").alias("u")).join(right.select("rank", F.col("id").alias("v")), "rank").select("u", "v")
        drawn = met if drawn is None else drawn.unionByName(met)
        if (k + 1) % tries == 0 or k + 1 == most:
            drawn = cut(E.distinct_pairs(drawn).join(pairs, ["u", "v"], "left_anti"))
            if drawn.count() >= wanted:
                break
    rows = drawn.withColumn("__h", shuffled(seed - 1, "u", "v"))
    return ranked(rows, [F.asc("__h"), F.asc("u"), F.asc("v")]).where(F.col("rank") <= wanted).select("u", "v")


def pair_features(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` with ``x``: both vectors, the absolute difference and the product, element by element.

    Pairs without a vector at either end are left out; hot ends are spread over tasks.
    """
    for end in ("u", "v"):
        hot = skew.hot_keys(pairs, end)
        side = skew.replicate(vectors.select(F.col("id").alias(end), F.col("vector").alias(f"__{end}")), end, hot, 16, "__salt")
        pairs = pairs.withColumn("__salt", skew.salt(end, F.monotonically_increasing_id(), hot, 16)).join(side, [end, "__salt"]).drop("__salt")
    return pairs.withColumn("x", features(F.col("__u"), F.col("__v"))).drop("__u", "__v")


def features(a: Column, b: Column) -> Column:
    x = F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))
    return F.transform(x, lambda e: e.cast("double"))
