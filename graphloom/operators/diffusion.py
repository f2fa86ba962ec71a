"""Personalized PageRank on weighted undirected graphs, as joins and sums."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..runtime import cut
from . import edges as E

SALTS = 16


def seed_vector(seeds: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, p)`` with a sum of 1 from ``seeds(id, weight)``.

    A weight that is NULL or NaN counts as 1; weights of 0 or less don't count; those of an id
    add up. ``nodes(id)``: only seeds among them count.
    """
    w = F.when(F.col("weight").isNull() | F.isnan("weight"), 1.0).otherwise(F.col("weight").cast("double"))
    rows = seeds.where("id is not null").select("id", w.alias("w")).where("w > 0")
    if nodes is not None:
        rows = rows.join(nodes.select("id").distinct(), "id", "left_semi")
    sums = rows.groupBy("id").agg(F.sum("w").alias("w"))
    whole = sums.agg(F.sum("w").alias("whole"))  # one row
    return sums.join(F.broadcast(whole), how="cross").select("id", (F.col("w") / F.col("whole")).alias("p"))


def pagerank(
    graphs: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 500, tolerance: float | None = 1e-10, every: int = 10
) -> DataFrame:
    """``(graph, id, score, iterations, converged)`` of canonical edges ``graph, u, v, w``.

    ``seeds(id, weight)`` are restricted to the nodes of each graph. Scores start even and are
    moved along the edges by weight; ``1 - alpha`` of them returns to the seeds. All graphs
    move in the same joins. Every ``every`` rounds lineage is cut and, with a ``tolerance``, the change of
    the last round, summed over a graph, is compared with it times the graph's nodes; a graph that moved less is
    done and leaves. With a ``tolerance`` of None there are exactly ``iterations`` rounds
    and ``converged`` is NULL; a graph not done after ``iterations`` rounds comes out with ``converged`` false.
    A graph that holds no seed gives no rows (``without_seeds`` names it).
    Edges stay partitioned by source and the scores, one row a node, are shuffled to them (or sent, where Spark finds them small);
    edges of hot nodes are spread over tasks.
    """
    moves = cut(E.both_ways(E.positive(graphs).select("graph", "u", "v", "w")))
    out = moves.groupBy("graph", "src").agg(F.sum("w").alias("out"))
    nodes = cut(out.select("graph", F.col("src").alias("id"), "out"))
    size = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))  # one row per graph
    wt = F.when(F.col("weight").isNull() | F.isnan("weight"), 1.0).otherwise(F.col("weight").cast("double"))
    given = seeds.where("id is not null").select("id", wt.alias("s")).where("s > 0").groupBy("id").agg(F.sum("s").alias("s"))
    here = nodes.select("graph", "id").join(given, "id")
    whole = here.groupBy("graph").agg(F.sum("s").alias("whole"))
    start = here.join(F.broadcast(whole), "graph").select("graph", "id", (F.col("s") / F.col("whole")).alias("p"))
    nodes = nodes.join(F.broadcast(size.join(whole, "graph")), "graph").join(start, ["graph", "id"], "left")
    nodes = cut(nodes.select("graph", "id", "out", F.coalesce("p", F.lit(0.0)).alias("p"), (1 / F.col("n")).alias("x")))
    hot = skew.hot_keys(moves, "src")
    none = F.lit(0.0)
    steps = _with_out(moves, nodes, hot).select("graph", "src", "dst", (F.col("w") / F.col("out")).alias("share"), none.alias("p"), none.alias("own"))
    # A step from each node to itself brings its part of the restart and tells its last score.
    steps = steps.unionByName(nodes.select("graph", F.col("id").alias("src"), F.col("id").alias("dst"), none.alias("share"), "p", F.lit(1.0).alias("own")))
    steps = steps.withColumn("salt", skew.salt("src", F.col("dst"), hot, SALTS))
    steps = cut(steps.repartition("graph", "src", "salt"))

    def moved(x: DataFrame) -> DataFrame:
        met = steps.join(skew.replicate(x.select("graph", F.col("id").alias("src"), "x"), "src", hot, SALTS), ["graph", "src", "salt"])
        sums = met.groupBy("graph", F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("x")).alias("m"), F.sum("p").alias("p"), F.sum(F.col("own") * F.col("x")).alias("before"))
        return sums.select("graph", "id", (alpha * F.col("m") + (1 - alpha) * F.col("p")).alias("x"), "before")

    x, round_no, finished = nodes.select("graph", "id", "x"), 0, []
    while round_no < iterations:
        rounds = min(every, iterations - round_no)
        for _ in range(rounds):
            x = moved(x)
        round_no, x = round_no + rounds, cut(x)
        if tolerance is None:
            continue
        # One row per graph.
        change = x.groupBy("graph").agg((F.sum(F.abs(F.col("x") - F.col("before"))) < F.count(F.lit(1)) * tolerance).alias("done")).collect()
        done = [r["graph"] for r in change if r["done"]]
        if done:
            finished.append(_scored(x.where(F.col("graph").isin(done)), round_no, True))
            x = x.where(~F.col("graph").isin(done))
            steps = steps.where(~F.col("graph").isin(done))
        if len(done) == len(change):
            return functools.reduce(DataFrame.unionByName, finished) if finished else _scored(x, round_no, True)
    return functools.reduce(DataFrame.unionByName, [*finished, _scored(x, round_no, None if tolerance is None else False)])


def _with_out(moves: DataFrame, nodes: DataFrame, hot: list) -> DataFrame:
    """``moves`` with the weight that leaves their source in all."""
    salted = moves.withColumn("salt", skew.salt("src", F.col("dst"), hot, SALTS))
    return salted.join(skew.replicate(nodes.select("graph", F.col("id").alias("src"), "out"), "src", hot, SALTS), ["graph", "src", "salt"])


def _scored(x: DataFrame, rounds: int, converged: bool | None) -> DataFrame:
    return x.select("graph", "id", F.col("x").alias("score"), F.lit(rounds).alias("iterations"), F.lit(converged).cast("boolean").alias("converged"))


def without_seeds(graphs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(graph)`` of the graphs with edges but no node that has a seed of positive weight; ``pagerank`` leaves them out."""
    nodes = E.positive(graphs).select("graph", F.explode(F.array("u", "v")).alias("id")).distinct()
    held = nodes.join(seed_vector(seeds).select("id"), "id", "left_semi").select("graph").distinct()
    return nodes.select("graph").distinct().join(held, "graph", "left_anti")
