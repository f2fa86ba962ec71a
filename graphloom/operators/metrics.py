"""How well a ranking finds the positives."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def label_map(labels: DataFrame, order: str | None = None) -> DataFrame:
    """``(id, y)``: 1.0 for a value above 0, otherwise (0, negative, NaN) 0.0; the last row by ``order`` counts."""
    y = F.when((F.col("value") > 0) & ~F.isnan(F.col("value").cast("double")), 1.0).otherwise(0.0)
    rows = labels.where("id is not null and value is not null")
    if order is None:
        return rows.groupBy("id").agg(F.max(y).alias("y"))
    return rows.groupBy("id").agg(F.max(F.struct(F.col(order).alias("o"), y.alias("y")))["y"].alias("y"))


def curve(scored: DataFrame) -> DataFrame:
    """Rows of ``graph, id, score, y`` with ``rank``, true positives so far (``tp``), precision and recall.

    Ranked by score, the smaller id first among equals; rows count one by one, ties are not merged.
    """
    rows = ranked(scored, [F.desc("score"), F.asc("id")], ["graph"], "y")
    whole = scored.groupBy("graph").agg(F.sum("y").alias("positives"))
    rows = rows.join(F.broadcast(whole), "graph")
    return rows.withColumnRenamed("running", "tp").withColumns(
        {"precision": F.col("tp") / F.col("rank"), "recall": F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0)}
    )


def summary(scored: DataFrame, k: int) -> DataFrame:
    """One row per graph: AUPRC (step rule), and precision, recall and enrichment of the first ``k``.

    AUPRC is NaN without positives, enrichment NULL then. Precision divides by the length of
    the list, which is shorter than ``k`` where there are fewer candidates.
    """
    rows = curve(scored)
    first = F.col("rank") <= k
    sums = rows.groupBy("graph").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum("y").alias("n_pos_eval"),
        F.sum(F.col("y") * F.col("precision")).alias("area"),
        F.sum(F.when(first, F.col("y")).otherwise(0.0)).alias("tp"),
        F.count_if(first).alias("listed"),
    )
    precision = F.col("tp") / F.greatest(F.lit(1), "listed")
    base = F.col("n_pos_eval") / F.greatest(F.lit(1), "n_candidates")
    return sums.select(
        "graph",
        "n_candidates",
        F.col("n_pos_eval").cast("long").alias("n_pos_eval"),
        F.when(F.col("n_pos_eval") > 0, F.col("area") / F.col("n_pos_eval")).otherwise(float("nan")).alias("auprc"),
        precision.alias("precision_at_k"),
        (F.col("tp") / F.greatest(F.lit(1.0), "n_pos_eval")).alias("recall_at_k"),
        F.when(base > 0, precision / base).alias("enrich_factor_at_k"),
    )


def candidates(scores: DataFrame, seeds: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranked nodes other than the seeds, with their label; a node without one is negative."""
    rest = scores.join(seeds.select("id").where("id is not null").distinct(), "id", "left_anti")
    return rest.join(labels.select("id", "y"), "id", "left").select("graph", "id", "score", F.coalesce("y", F.lit(0.0)).alias("y"))


def evaluation(scores: DataFrame, seeds: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``summary`` of each graph's candidates with what it was counted from, seeds included: nodes, seeds, positives, rounds.

    ``scores`` has ``graph, id, score, iterations, converged``. A graph without another node than seeds has no candidates and NULL in their place.
    """
    known = seeds.select("id", F.lit(True).alias("seed")).where("id is not null").distinct()
    told = scores.join(known, "id", "left").join(labels.select("id", "y"), "id", "left")
    counts = told.groupBy("graph").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count("seed").alias("n_seeds_in_graph"),
        F.count_if(F.col("y") > 0).alias("n_pos_total"),
        F.max("iterations").alias("iterations"),
        F.bool_and("converged").alias("converged"),
    )
    return counts.join(summary(candidates(scores, seeds, labels), k), "graph", "left")


def by_metric(summaries: DataFrame, metric: str) -> DataFrame:
    """The greatest ``metric`` first, missing ones last, then by name; as it is where there is no such column."""
    return summaries.orderBy(F.desc_nulls_last(metric), "graph") if metric in summaries.columns else summaries


def named(summaries: DataFrame, names: dict[str, str]) -> DataFrame:
    """Graphs under the names given for them, without ``.tsv``; others keep theirs."""
    plain = F.replace(F.col("graph"), F.lit(".tsv"), F.lit(""))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,string>")
    return summaries.withColumn("graph", F.coalesce(table[plain], plain))


def best_first(summaries: DataFrame) -> DataFrame:
    """Graphs with ``place``: by AUPRC, then recall, missing ones first, then name. One row per graph."""
    order = [F.desc_nulls_first("auprc"), F.desc_nulls_first("recall_at_k"), F.asc("graph")]
    return ranked(summaries, order).withColumnRenamed("rank", "place")
