"""Graphs made of similarities and of other graphs."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..runtime import cut
from . import edges as E
from .normalize import gate, over_graph, over_source, top_per_source
from .sequences import linked
from .vectors import exact_neighbours

SALTS = 16


def neighbour_graph(queries: DataFrame, base: DataFrame, candidates: int = 500, top: int = 20, weight: str = "cos_pos", temperature: float = 0.1) -> DataFrame:
    """Undirected ``(u, v, w)`` from the ``candidates`` most similar rows of each query.

    ``weight``: cos_pos keeps cosines above 0 as they are; row_softmax takes the softmax over the
    candidates of a query. The ``top`` heaviest of each query are kept after that, and of an edge
    found from both sides the greater weight. Only positive weights make an edge.
    """
    found = exact_neighbours(queries, base, candidates).drop("rank")
    if weight == "cos_pos":
        weighed = found.withColumn("w", F.greatest("w", F.lit(0.0)))
    elif weight == "row_softmax":
        weighed = over_source(found, "softmax", temperature=temperature)
    else:
        raise ValueError(f"no such weight: {weight}")
    return from_candidates(weighed, top)


def from_candidates(scored: DataFrame, top: int, only_positive: bool = True) -> DataFrame:
    """The undirected graph of each source's ``top`` heaviest candidates in ``src, dst, w``."""
    best = top_per_source(scored, top).select(F.col("src").alias("u"), F.col("dst").alias("v"), "w")
    merged = E.merge_max(best)
    return E.positive(merged) if only_positive else merged


def with_items(pairs: DataFrame, items: DataFrame, sources_at_once: int | None = None) -> DataFrame:
    """``pairs(src, dst)`` with the items of both ends as structs ``a`` and ``b``; pairs without them are left out.

    Hot ends are spread over tasks. Few sources with many pairs each: with ``sources_at_once``, the items of so many sources are broadcast
    at a time, so that no item is shuffled once a pair.
    """
    rest = F.struct(*[c for c in items.columns if c != "id"])
    a, b = items.select(F.col("id").alias("src"), rest.alias("a")), items.select(F.col("id").alias("dst"), rest.alias("b"))
    if sources_at_once is None:
        for end, side in (("src", a), ("dst", b)):
            hot = skew.hot_keys(pairs, end)
            salted = pairs.withColumn("__salt", skew.salt(end, F.monotonically_increasing_id(), hot, SALTS))
            pairs = salted.join(skew.replicate(side, end, hot, SALTS, "__salt"), [end, "__salt"]).drop("__salt")
        return pairs
    a = cut(a.join(pairs.select("src").distinct(), "src", "left_semi"))
    blocks, out = max(1, -(-a.count() // sources_at_once)), None
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("src"), F.lit(blocks)) == k
        part = pairs.where(mine).join(b.hint("merge"), "dst").join(F.broadcast(a.where(mine)), "src")
        out = part if out is None else out.unionByName(part)
    return out


def score_pairs(pairs: DataFrame, items: DataFrame, score: Column, sources_at_once: int | None = None) -> DataFrame:
    """``(src, dst, w)``: ``score`` of each pair; scores that are no finite numbers count as 0. See ``scored_graph``."""
    scored = with_items(pairs.select("src", "dst"), items, sources_at_once).withColumn("w", score.cast("double"))
    sound = F.when(F.isnan("w") | (F.abs("w") == float("inf")), 0.0).otherwise(F.coalesce("w", F.lit(0.0)))
    return scored.select("src", "dst", sound.alias("w"))


def joint_surplus(pairs: DataFrame, items: DataFrame, score: Callable[[Column], Column], linker: int = 10) -> DataFrame:
    """``(src, dst, w)``: what ``score`` finds in the linked pair of sequences beyond what it finds in either alone.

    ``items`` has ``id, seq``; ``score`` makes a column of one of sequences, by an expression or a model. Each
    sequence is scored once alone, however many pairs it is in.
    """
    single = cut(items.select("id", "seq", score(F.col("seq")).cast("double").alias("alone")))
    joint = score(linked(F.col("a.seq"), F.col("b.seq"), linker)).cast("double")
    return score_pairs(pairs, single, joint - F.col("a.alone") - F.col("b.alone"))


def scored_graph(candidates: DataFrame, items: DataFrame, score: Column, top: int = 20, norm: str = "sigmoid_z", temperature: float = 1.0, sources_at_once: int | None = None) -> DataFrame:
    """Undirected graph of candidate pairs ``src, dst`` weighed by ``score``.

    ``items`` has ``id`` and whatever ``score`` reads, as ``a.<column>`` of the source and
    ``b.<column>`` of the target; ``score`` may be an expression or call a vectorized UDF, such
    as those of ``scorers``. Scores that are no finite numbers count as 0. They are normalised
    over the candidates of a source before the ``top`` are taken. ``sources_at_once``: see ``with_items``.
    """
    scored = score_pairs(candidates, items, score, sources_at_once)
    return from_candidates(over_source(scored, norm, temperature=temperature), top)


def merge_parts(parts: DataFrame) -> DataFrame:
    """Part files of one graph as one: the greatest weight of each undirected pair, if positive."""
    return E.positive(E.merge_max(parts))


def _with_signal(prior: DataFrame, signal: DataFrame, order: str) -> DataFrame:
    """``prior`` with ``p``, the last signal of the pair by ``order``, 0 where there is none."""
    last = E.last_of_pair(signal, order).select(F.col("u").alias("__a"), F.col("v").alias("__b"), F.col("w").alias("p"))
    pair = (F.least("u", "v") == F.col("__a")) & (F.greatest("u", "v") == F.col("__b"))
    return prior.join(last, pair, "left").withColumn("p", F.coalesce("p", F.lit(0.0))).drop("__a", "__b")


def reweight(prior: DataFrame, signal: DataFrame, beta: float = 1.0, form: str = "exp", norm: str = "minmax", order: str = "line_no") -> DataFrame:
    """The prior's edges with normalised weights, each times the gate of its signal.

    Orientation, repeated edges and zero weights of the prior stay as they are.
    """
    scaled = over_graph(E.clean(prior), norm)
    gated = _with_signal(scaled, signal, order)
    return gated.select("u", "v", (F.col("w") * gate(F.col("p"), beta, form)).alias("w"))


def gated_mix(prior: DataFrame, signal: DataFrame, share: float = 0.5, beta: float = 1.0, form: str = "exp", norm: str = "minmax", order: str = "line_no") -> DataFrame:
    """``share`` of the gated prior plus the rest of the signal; edges of either side come out.

    Repeated edges of a side add up, while the gate takes the last signal. Only positive sums stay.
    """
    gated = reweight(prior, signal, beta, form, norm, order)
    both = gated.withColumn("w", share * F.col("w")).unionByName(E.clean(signal).withColumn("w", (1 - share) * F.col("w")))
    return E.positive(E.merge_sum(both))
