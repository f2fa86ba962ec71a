"""Queries of the numbered problems and their SQL."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators.vectors import exact_neighbours
from ..plans.orphan_queries import canonical_sql
from ..plans.tables import table
from ..runtime import cut
from . import leakage, similar_vectors, split_items, split_overlap, tokenizer, top_items, truncation

# 1: splitting oversized sequences


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_items.split_oversized(table(spark, folder, "seqs"), "rec_id", "seq")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pieces(spark, folder).where("piece_no = 0").select("rec_id")


def p1_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of each divided record the digest of what its pieces cover, overlaps taken off, and whether each piece fits and shares what it has to."""
    p = p1_pieces(spark, folder).withColumn("new", F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substr("piece", F.lit(split_items.OVERLAP + 1))))
    p = p.withColumn("before", F.lag("piece").over(Window.partitionBy("rec_id").orderBy("piece_no")))
    shares = F.coalesce(F.right("before", F.lit(split_items.OVERLAP)) == F.left("piece", F.lit(split_items.OVERLAP)), F.lit(True))
    # As many pieces as a record has.
    pieces = F.sort_array(F.collect_list(F.struct("piece_no", "new")))
    return p.groupBy("rec_id").agg(
        F.md5(F.array_join(F.transform(pieces, lambda x: x["new"]), "")).alias("digest"), F.bool_and((F.length("piece") <= split_items.MAX_LENGTH) & shares).alias("fits")
    )


# 3: the most similar vectors of every vector


def current_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The usable rows of ``node_embeddings``, of several of one node (or unknown id or text) the last loaded."""
    e = table(spark, folder, "node_embeddings").where(similar_vectors.usable(F.col("emb"), 64))
    former = ids.former_ids(table(spark, folder, "nodes"))
    named = ids.resolve(ids.with_canonical(e.select("rec_id", "ids", "loaded_at"), node="ids"), ["node"], former)
    by = F.when(ids.is_blank(F.col("ids")), F.concat(F.lit("row "), "rec_id")).otherwise(F.coalesce("node", F.concat(F.lit("text "), "ids")))
    last = named.groupBy(by.alias("by")).agg(F.max(F.struct("loaded_at", "rec_id")).alias("last"))
    return e.select("rec_id", "emb").join(last.select("last.rec_id"), "rec_id", "left_semi")


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors.most_similar(current_vectors(spark, folder), "rec_id", "emb")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    near = p3_neighbours(spark, folder).where("cosine > 0.85")
    return near.select(F.least("rec_id", "neighbour").alias("rec_a"), F.greatest("rec_id", "neighbour").alias("rec_b")).distinct()


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours that brute force finds for ids divisible by 20 among all rows, how many of them the search finds, and the share."""
    rows = cut(current_vectors(spark, folder).select(F.col("rec_id").alias("id"), F.col("emb").alias("vector")))
    exact = exact_neighbours(rows.where("id % 20 = 0"), rows, 10).select(F.col("src").alias("rec_id"), F.col("dst").alias("neighbour"), "w")
    found = similar_vectors.most_similar(rows, "id", "vector").select(F.col("id").alias("rec_id"), "neighbour", F.lit(1).alias("hit"))
    both = exact.join(found, ["rec_id", "neighbour"], "left")
    near = F.col("w") > 0.85
    return both.agg(
        F.countDistinct("rec_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"), (F.count(F.when(near, F.col("hit"))) / F.count_if(near)).alias("recall_near"),
    )


# 4: the strongest partners of every node


def p4_top(spark: SparkSession, folder: str) -> DataFrame:
    """With weight and rank; see ``p4_found``."""
    rows = table(spark, folder, "signal_parts").select("u", "v", "w").where("w > 0 and not isnan(w)")
    return top_items.top_items(ids.with_canonical(rows, u="u", v="v").where("u <> v"), "u", "v", "w", 10)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_top(spark, folder).select("u", "v")


# 5: evaluation edges that the training split holds


def _edges(spark: SparkSession, folder: str, split: str, former: DataFrame) -> DataFrame:
    """``id, text, split, source``; the text has the two nodes in order, so that direction doesn't count."""
    rows = table(spark, folder, f"{split}_pos_edges").select(F.col("edge_id").alias("id"), "u", "v", "source")
    edges = ids.with_canonical(rows, a="u", b="v").select("id", "a", "b", "source")
    edges = ids.resolve(edges.where("a is not null and b is not null"), ["a", "b"], former).where("a <> b")
    return edges.select("id", F.concat_ws(" ", F.least("a", "b"), F.greatest("a", "b")).alias("text"), F.lit(split).alias("split"), "source")


def p5_rows(spark: SparkSession, folder: str) -> DataFrame:
    former = cut(ids.former_ids(table(spark, folder, "nodes")))
    train, val, test = (_edges(spark, folder, split, former) for split in ("train", "val", "test"))
    return split_overlap.overlapping_rows(cut(train), cut(val.unionByName(test)), words=2)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_rows(spark, folder).select(
        F.least("training_id", "evaluation_id").alias("edge_a"), F.greatest("training_id", "evaluation_id").alias("edge_b")
    )


def _normalised(text: str) -> Column:
    """Words in lower case with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    """Notebooks that show evaluation items almost: passages of five words that cover four fifths of an item or more."""
    training = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), _normalised("text").alias("text"))
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), _normalised("text").alias("text"), "split", F.col("kind").alias("source"))
    rows = split_overlap.overlapping_rows(training, items, words=5, least=0.8)
    return rows.select(F.col("training_id").alias("doc_id"), F.col("evaluation_id").alias("item_id"), "split", F.round("covered", 6).alias("covered"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation rows that leaked, and pairs of rows, per split and source."""
    return p5_rows(spark, folder).groupBy("split", "source").agg(
        F.countDistinct("evaluation_id").alias("n_rows"), F.count(F.lit(1)).alias("n_pairs")
    )


# 6: token ids


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


# 7: evaluation items that notebooks show


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents show each item."""
    return p7_leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("cover").alias("most"))


# 8: notebooks that were cut off


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.score(table(spark, folder, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).where(F.col("score") >= truncation.DECISION).select("doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut texts among those with content, per source."""
    is_cut = F.col("score") >= truncation.DECISION
    return p8_scores(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(is_cut).alias("n_cut"), F.round(F.avg(is_cut.cast("double")), 6).alias("share")
    )


def p8_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """What the classifier calls cut of texts and artificial cuts that it wasn't fitted on."""
    return truncation.held_out_accuracy(table(spark, folder, "documents"), "doc_id", "text", "source")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p3_found, p3_neighbours, p3_recall, p4_found, p4_top, p5_found, p5_report, p5_items, p6_ids, p7_found, p7_items, p8_found, p8_report, p8_held_out)}

_TOP = f"""
WITH e AS (SELECT {canonical_sql("u")} AS u, {canonical_sql("v")} AS v, w FROM signal_parts WHERE w > 0 AND NOT isnan(w)),
b AS (SELECT u, v, max(w) AS w FROM e WHERE u <> v GROUP BY u, v),
t AS (SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS rank FROM b)
"""
_OVERLAPS = f"""
WITH n AS (SELECT {canonical_sql("id")} AS name, {canonical_sql("alias")} AS former FROM nodes),
former AS (SELECT former, min(name) AS node FROM n WHERE former IS NOT NULL AND name IS NOT NULL
 AND former NOT IN (SELECT name FROM n WHERE name IS NOT NULL) GROUP BY former),
raw AS (SELECT 'train' AS split, * FROM train_pos_edges UNION ALL SELECT 'val', * FROM val_pos_edges UNION ALL SELECT 'test', * FROM test_pos_edges),
c AS (SELECT split, edge_id, source, {canonical_sql("u")} AS u, {canonical_sql("v")} AS v FROM raw),
r AS (SELECT split, edge_id, source, coalesce(f.node, u) AS a, coalesce(g.node, v) AS b FROM c
 LEFT JOIN former f ON f.former = u LEFT JOIN former g ON g.former = v WHERE u IS NOT NULL AND v IS NOT NULL),
k AS (SELECT split, edge_id, source, least(a, b) || ' ' || greatest(a, b) AS pair FROM r WHERE a <> b),
pairs AS (SELECT t.edge_id AS ta, e.edge_id AS ea, e.split, e.source FROM k t JOIN k e ON t.pair = e.pair WHERE t.split = 'train' AND e.split <> 'train')
"""
_WORDS_OF = "list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_ITEMS = f"""
WITH d AS (SELECT doc_id, {_WORDS_OF} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, split, {_WORDS_OF} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
ig AS (SELECT item_id, split, len(w) AS n, k, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM (SELECT item_id, split, w, unnest(range(0, greatest(1, len(w) - 4))) AS k FROM i WHERE len(w) > 0)),
marks AS (SELECT DISTINCT doc_id, item_id, split, n, unnest(range(k, least(k + 5, n))) AS at_ FROM dg JOIN ig USING (g))
"""
SQL = {
    "p1_found": "SELECT rec_id FROM seqs WHERE length(regexp_replace(seq, '[^A-Za-z]', '', 'g')) > 1022",
    "p1_cover": "SELECT rec_id, md5(regexp_replace(seq, '[^A-Za-z]', '', 'g')) AS digest, TRUE AS fits FROM seqs WHERE length(regexp_replace(seq, '[^A-Za-z]', '', 'g')) > 1022",
    "p4_found": _TOP + "SELECT u, v FROM t WHERE rank <= 10",
    "p4_top": _TOP + "SELECT u, v, w, rank FROM t WHERE rank <= 10",
    "p5_found": _OVERLAPS + "SELECT least(ta, ea) AS edge_a, greatest(ta, ea) AS edge_b FROM pairs",
    "p5_items": _ITEMS + "SELECT doc_id, item_id, split, round(count(*) / n, 6) AS covered FROM marks GROUP BY doc_id, item_id, split, n HAVING count(*) / n >= 0.8",
    "p5_report": _OVERLAPS + "SELECT split, source, count(DISTINCT ea) AS n_rows, count(*) AS n_pairs FROM pairs GROUP BY 1, 2",
}
