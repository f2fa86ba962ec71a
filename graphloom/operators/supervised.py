"""A pair classifier that weighs candidate pairs.

Logistic regression over the pair features stands in for a network, which Spark's own learners
don't offer with the same layers and optimizer; weights are not comparable number by number.
"""

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from . import edges as E
from .graphs import from_candidates, with_items
from .splits import features, negatives, pair_features

PENALTIES = (0.0001, 0.001, 0.01)
_SURE = 1e-12


def labelled(positives: DataFrame, vectors: DataFrame, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """``(u, v, y, x)`` of the positives and as many degree-matched negatives; fails without positives or two nodes."""
    E.require(positives, "positive pairs")
    E.require(vectors.select("id").distinct(), "nodes with a vector", 2)
    both = positives.select("u", "v").withColumn("y", F.lit(1.0)).unionByName(negatives(positives, ratio, seed).withColumn("y", F.lit(0.0)))
    return cut(pair_features(cut(both), vectors).withColumn("x", array_to_vector("x")))


def train(examples: DataFrame, held_out: DataFrame, penalties: tuple[float, ...] = PENALTIES):
    """The model of the lowest loss on ``held_out``, over several penalties."""
    best = None
    for penalty in penalties:
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=penalty, maxIter=30).fit(examples)
        p = vector_to_array(F.col("probability"))[1]
        loss = -(F.col("y") * F.log(p + _SURE) + (1 - F.col("y")) * F.log(1 - p + _SURE))
        value = model.transform(held_out).agg(F.avg(loss)).first()[0]
        if best is None or (value is not None and value < best[0]):
            best = (value if value is not None else float("inf"), model)
    return best[1]


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def supervised_graph(candidates: DataFrame, vectors: DataFrame, model, top: int = 20, form: str = "sigmoid", sources_at_once: int | None = None) -> DataFrame:
    """Undirected graph of ``candidates(src, dst)`` weighed by the model's probability, or its logit.

    Logits may be negative, so no weight is left out for its sign. ``sources_at_once``: see ``graphs.with_items``.
    """
    if sources_at_once is None:
        pairs = pair_features(candidates.select(F.col("src").alias("u"), F.col("dst").alias("v")), vectors)
    else:
        pairs = with_items(candidates.select("src", "dst"), vectors.select("id", "vector"), sources_at_once)
        pairs = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"), features(F.col("a.vector"), F.col("b.vector")).alias("x"))
    scored = model.transform(pairs.withColumn("x", array_to_vector("x")))
    column = {"sigmoid": "probability", "logit": "rawPrediction"}[form]
    return from_candidates(scored.select(F.col("u").alias("src"), F.col("v").alias("dst"), vector_to_array(column)[1].alias("w")), top, only_positive=False)
