"""Records of evaluation splits that the training split holds as well, exactly or almost.

Evaluation texts are cut into passages of ``words`` consecutive words. They are sharded so that the
passages of a text stay together; each shard makes one Aho-Corasick automaton, which scans every
training text where it lies, without a shuffle. The matched intervals of an evaluation text
are merged into its coverage by the training text.
"""

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..runtime import cut

#: Characters of the passages of a shard at most, but for one longer text; an automaton takes some ten bytes each.
SHARD = 16_000_000
SALTS = 32
_made: dict = {}


class _Passages:
    """The automaton of a shard's passages and where each stands in which text."""

    def __init__(self, texts: list[tuple[int, str]], words: int) -> None:
        self.words, self.sizes = words, {}
        places = defaultdict(list)
        for number, text in texts:
            w = text.split(" ")
            self.sizes[number] = len(w)
            for at in range(max(1, len(w) - words + 1)):
                places[" ".join(w[at : at + words])].append((number, at))
        self.automaton = ahocorasick.Automaton()
        for passage, where in places.items():
            self.automaton.add_word(f" {passage} ", where)
        if places:
            self.automaton.make_automaton()

    def coverage(self, text: str) -> Iterator[tuple[int, float]]:
        """Evaluation texts of which ``text`` shows a passage, and the share of their words that such passages cover."""
        if not self.sizes:
            return
        begins = defaultdict(set)
        for _, where in self.automaton.iter(f" {text} "):
            for number, at in where:
                begins[number].add(at)
        for number, places in begins.items():
            size, covered, end = self.sizes[number], 0, 0
            for at in sorted(places):
                reach = min(at + self.words, size)
                covered, end = covered + reach - max(at, end), reach
            yield number, covered / size


def _passages(name: str, sent: Broadcast, words: int) -> _Passages:
    """One automaton at a time is kept by a worker, for all its tasks."""
    if _made.get("name") != name:
        _made.clear()
        _made.update(name=name, value=_Passages(sent.value, words))
    return _made["value"]


def matches(training: DataFrame, evaluation: DataFrame, words: int, least: float, shard: int = SHARD) -> DataFrame:
    """``(training_id, text_no, covered)`` of training rows that show ``least`` or more of an evaluation text.

    ``evaluation`` has ``text_no, text``, different texts of normalised words with single blanks between them,
    and ``training`` ``id, text``. NULL and empty texts show nothing. The training texts are read
    once for each shard.
    """
    spark, kind = training.sparkSession, training.schema["id"].dataType.simpleString()
    evaluation = evaluation.where("text <> ''")
    characters = evaluation.agg(F.coalesce(F.sum(F.length("text").cast("long") * words), F.lit(0))).first()[0]
    shards, found = max(1, -(-characters // shard)), None
    texts = training.select("id", "text").where("text <> ''")
    for number in range(shards):
        own = evaluation.where(F.pmod(F.xxhash64("text_no"), F.lit(shards)) == number)
        sent = spark.sparkContext.broadcast([(r["text_no"], r["text"]) for r in own.select("text_no", "text").collect()])

        def scan(batches: Iterator[pd.DataFrame], sent=sent, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            passages = _passages(name, sent, words)
            for batch in batches:
                rows = [(i, number, share) for i, text in zip(batch["id"], batch["text"]) for number, share in passages.coverage(text) if share >= least]
                yield pd.DataFrame(rows, columns=["training_id", "text_no", "covered"])

        part = cut(texts.mapInPandas(scan, f"training_id {kind}, text_no long, covered double"))
        sent.destroy()  # one shard at a time is held
        found = part if found is None else found.unionByName(part)
    return found


def overlapping_rows(training: DataFrame, evaluation: DataFrame, words: int, least: float = 1.0, shard: int = SHARD) -> DataFrame:
    """``(training_id, evaluation_id, split, source, covered)`` of rows whose texts overlap by ``least`` or more.

    ``training`` has ``id, text``, ``evaluation`` has ``id, text, split, source``; see ``matches``. ``covered`` is
    the share of the evaluation text's words that lie in passages which the training text
    shows. Every pair of rows comes out, double rows included; a text that a great share of the
    training rows show is spread over ``SALTS`` tasks.
    """
    texts = cut(evaluation.select("text").where("text <> ''").distinct().withColumn("text_no", F.monotonically_increasing_id()))
    found = matches(training, texts, words, least, shard)
    rows = evaluation.select(F.col("id").alias("evaluation_id"), "text", "split", "source")
    hot = skew.hot_keys(rows, "text")
    rows = rows.withColumn("salt", skew.salt("text", F.col("evaluation_id"), hot, SALTS))
    rows = rows.join(skew.replicate(texts, "text", hot, SALTS), ["text", "salt"]).drop("text", "salt")
    hot = skew.hot_keys(found, "text_no")
    found = found.withColumn("salt", skew.salt("text_no", F.col("training_id"), hot, SALTS))
    pairs = found.join(skew.replicate(rows, "text_no", hot, SALTS), ["text_no", "salt"])
    return pairs.select("training_id", "evaluation_id", "split", "source", "covered")
