"""Queries over embeddings and sequences.

Searches take as queries every row whose id is divisible by 20 and look among all rows; of node ids
the eleven digits count.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import graphs, normalize, quality, scorers, sequences, splits, supervised, vectors
from ..operators import edges as E
from ..runtime import cut
from .graph_queries import prior
from .orphan_queries import canonical_sql
from .tables import table

CANDIDATES, TOP, EVERY = 20, 10, 20
#: Candidates of a node and those kept, as the reference has them; sources whose items are broadcast at once.
NEAREST, HEAVIEST, AT_ONCE = 500, 20, 4096
SIZE = 64
WINDOW, STRIDE = 1022, 768


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _queries(base: DataFrame) -> DataFrame:
    return base.where(F.col("id") % EVERY == 0)


def node_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, vector)`` of the listed nodes: of the usable rows of a node, under its id or a former one, the last loaded."""
    v = F.col("emb")
    usable = F.coalesce((F.size(v) == SIZE) & vectors.finite(v) & F.exists(v, lambda x: x != 0), F.lit(False))
    nodes = table(spark, folder, "nodes")
    rows = ids.with_canonical(table(spark, folder, "node_embeddings").where(usable).select("ids", "emb", "loaded_at", "rec_id"), id="ids")
    named = ids.resolve(rows.where("id is not null"), ["id"], ids.former_ids(nodes))
    last = named.groupBy("id").agg(F.max_by("emb", F.struct("loaded_at", "rec_id")).alias("vector"))
    return last.join(nodes.select(ids.canonical(F.col("id")).alias("id")), "id", "left_semi")


def _node_queries(base: DataFrame) -> DataFrame:
    return base.where(F.substring_index("id", "FMPP", -1).cast("long") % EVERY == 0)


def cosine_topm(spark, folder):
    base = embeddings(spark, folder)
    return vectors.exact_neighbours(_queries(base), base, CANDIDATES).select("src", "dst", F.round("w", 6).alias("cos"), "rank")


def knn_cos_pos(spark, folder):
    base = embeddings(spark, folder)
    return graphs.neighbour_graph(_queries(base), base, CANDIDATES, TOP).withColumn("w", F.round("w", 6))


def knn_row_softmax(spark, folder):
    base = embeddings(spark, folder)
    return graphs.neighbour_graph(_queries(base), base, CANDIDATES, TOP, "row_softmax", 0.05).withColumn("w", F.round("w", 6))


def cosine_top500(spark, folder):
    base = embeddings(spark, folder)
    return vectors.exact_neighbours(_queries(base), base, NEAREST).select("src", "dst", F.round("w", 6).alias("cos"), "rank")


def knn_cos_pos_500(spark, folder):
    base = embeddings(spark, folder)
    return graphs.neighbour_graph(_queries(base), base, NEAREST, HEAVIEST).withColumn("w", F.round("w", 6))


def knn_row_softmax_500(spark, folder):
    base = embeddings(spark, folder)
    return graphs.neighbour_graph(_queries(base), base, NEAREST, HEAVIEST, "row_softmax", 0.05).withColumn("w", F.round("w", 6))


def knn_nodes_cos_pos(spark, folder):
    """The neighbour graph of the listed nodes by their own embeddings."""
    base = cut(node_vectors(spark, folder))
    return graphs.neighbour_graph(_node_queries(base), base, NEAREST, HEAVIEST).withColumn("w", F.round("w", 6))


def knn_nodes_softmax(spark, folder):
    base = cut(node_vectors(spark, folder))
    return graphs.neighbour_graph(_node_queries(base), base, NEAREST, HEAVIEST, "row_softmax", 0.05).withColumn("w", F.round("w", 6))


def node_norm_quantiles(spark, folder):
    return quality.quantiles(quality.norms(node_vectors(spark, folder)), "norm").withColumn("value", F.round("value", 6))


def emb_unit(spark, folder):
    rows = embeddings(spark, folder).select("id", F.posexplode(vectors.unit(F.col("vector"))).alias("at", "x"))
    return rows.select("id", "at", F.round("x", 6).alias("x"))


def emb_norm_quantiles(spark, folder):
    return quality.quantiles(quality.norms(embeddings(spark, folder)), "norm").withColumn("value", F.round("value", 6))


def emb_finite_check(spark, folder):
    rows = table(spark, folder, "node_embeddings").select(F.col("rec_id").alias("id"), F.col("emb").alias("vector"))
    return quality.finite_report(rows)


def cos_top1_quantiles(spark, folder):
    base = embeddings(spark, folder)
    return quality.quantiles(quality.top_similarities(_queries(base), base), "first").withColumn("value", F.round("value", 6))


def cos_top5_quantiles(spark, folder):
    base = embeddings(spark, folder)
    return quality.quantiles(quality.top_similarities(_queries(base), base, 5), "last").withColumn("value", F.round("value", 6))


def rank_corr(spark, folder):
    """Between the length of a sequence and the share of it that is masked."""
    r = sequences.residues(F.col("seq"))
    rows = table(spark, folder, "seqs").select("rec_id", F.length(r).alias("size"), (F.length(r) - F.length(F.regexp_replace(r, "X", ""))).alias("masked"))
    return quality.rank_correlation(rows, "rec_id", "size", "masked").withColumn("correlation", F.round("correlation", 6))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, seq)`` of the FASTA records: of repeated headers the last, without empty bodies."""
    rows = ids.with_canonical(table(spark, folder, "seqs").select("id", "seq", "rec_id"), id="id").withColumn("seq", sequences.residues(F.col("seq")))
    return sequences.last_of_id(rows.where("id is not null"), "rec_id").where("length(seq) > 0")


def seq_prepare(spark, folder):
    """Listed nodes with a sequence, in the order of the list, with true lengths."""
    listed = table(spark, folder, "nodes").select(ids.canonical(F.col("id")).alias("id"), "pos").groupBy("id").agg(F.min("pos").alias("pos"))
    return listed.join(records(spark, folder), "id").select("id", "pos", F.length("seq").alias("size"))


def seq_missing(spark, folder):
    """Listed nodes without a sequence."""
    listed = table(spark, folder, "nodes").select(ids.canonical(F.col("id")).alias("id")).distinct()
    return listed.join(records(spark, folder), "id", "left_anti")


def seq_windows(spark, folder):
    return sequences.windows(records(spark, folder), "id", "seq", WINDOW, STRIDE)


def seq_length_bucket(spark, folder):
    rows = records(spark, folder).groupBy(sequences.length_bucket(F.col("seq")).alias("bucket"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("longest"))


def seq_layout(spark, folder):
    s = F.col("seq")
    return records(spark, folder).select("id", F.md5(sequences.wrapped(s)).alias("wrapped"), F.md5(sequences.spaced(s)).alias("spaced"))


def _pairs(spark, folder):
    pairs = cut(prior(spark, folder).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    met = graphs.with_items(pairs, cut(records(spark, folder)))
    return met.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("a.seq").alias("u_seq"), F.col("b.seq").alias("v_seq"))


def seq_linker_pairs(spark, folder):
    joint = sequences.linked(F.col("u_seq"), F.col("v_seq"))
    return _pairs(spark, folder).select("u", "v", F.length(joint).alias("size"), F.md5(joint).alias("digest"))


def pair_scored_jaccard(spark, folder):
    """The prior's pairs, either way, weighed by shared 3-mers and scaled over each source."""
    items = cut(records(spark, folder).select("id", scorers.kmer_codes(F.col("seq")).alias("kmers")))
    pairs = cut(prior(spark, folder).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    scored = graphs.score_pairs(pairs, items, scorers.jaccard(F.col("a.kmers"), F.col("b.kmers")))
    both = E.both_ways(scored.withColumnsRenamed({"src": "u", "dst": "v"}))
    return graphs.from_candidates(normalize.over_source(both, "minmax"), TOP).withColumn("w", F.round("w", 6))


def pair_surplus(spark, folder):
    """The prior's pairs by the distinct 3-mers of the linked pair less those of either sequence."""
    pairs = cut(prior(spark, folder).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    return graphs.joint_surplus(pairs, records(spark, folder), lambda seq: F.size(scorers.kmers(seq)))


def pair_scored_candidates(spark, folder):
    """The nearest nodes by embedding, of those that have a sequence, weighed by shared 3-mers and scaled over each source."""
    items = cut(records(spark, folder).select("id", scorers.kmer_codes(F.col("seq")).alias("kmers")))
    base = cut(node_vectors(spark, folder).join(items, "id", "left_semi"))
    near = vectors.exact_neighbours(_node_queries(base), base, NEAREST)
    out = graphs.scored_graph(near, items, scorers.jaccard(F.col("a.kmers"), F.col("b.kmers")), HEAVIEST, "minmax", sources_at_once=AT_ONCE)
    return out.withColumn("w", F.round("w", 6))


def embed_pooled(spark, folder):
    """Sequences encoded window by window and averaged over their windows; the composition stands in for a model."""
    parts = sequences.windows(records(spark, folder), "id", "seq", WINDOW, STRIDE)
    encoded = parts.select("id", scorers.composition_encoder(F.col("window")).alias("vector"))
    pooled = sequences.mean_of_windows(encoded, "id", "vector")
    rows = pooled.select("id", F.posexplode("vector").alias("at", "x"))
    return rows.select("id", "at", F.round("x", 5).alias("x"))


def _compositions(spark, folder):
    return records(spark, folder).select("id", scorers.composition_encoder(F.col("seq")).alias("vector"))


def pair_features(spark, folder):
    rows = splits.pair_features(prior(spark, folder).select("u", "v"), _compositions(spark, folder))
    return rows.select("u", "v", F.round(F.aggregate("x", F.lit(0.0), lambda s, e: s + e), 4).alias("total"), F.size("x").alias("n"))


def supervised_graph(spark, folder):
    """A classifier of the prior's pairs, trained on the training part, weighs the nearest nodes by embedding."""
    held = cut(node_vectors(spark, folder).select("id", vectors.unit(F.col("vector")).alias("vector")))
    parted = cut(splits.edge_split(prior(spark, folder)))
    train, val = (supervised.labelled(parted.where(F.col("split") == s), held) for s in ("train", "val"))
    model = supervised.train(train, val)
    near = vectors.exact_neighbours(_node_queries(held), held, NEAREST)
    return supervised.supervised_graph(near, held, model, HEAVIEST, sources_at_once=AT_ONCE)


def edge_split_held(spark, folder):
    """The split of the pairs whose nodes are listed and have a usable vector."""
    return splits.edge_split(E.within(prior(spark, folder), node_vectors(spark, folder).select("id")))


QUERIES = {
    f.__name__: f
    for f in (
        edge_split_held, cosine_topm, knn_cos_pos, knn_row_softmax, emb_unit, emb_norm_quantiles, emb_finite_check, cos_top1_quantiles, rank_corr, seq_prepare,
        seq_missing, seq_windows, seq_length_bucket, seq_layout, seq_linker_pairs, pair_scored_jaccard, embed_pooled, pair_features, supervised_graph,
        pair_surplus, knn_nodes_cos_pos, knn_nodes_softmax, node_norm_quantiles, cos_top5_quantiles, pair_scored_candidates, cosine_top500, knn_cos_pos_500, knn_row_softmax_500,
    )
}

_COS = """x AS (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_dot_product(v, v)) + 1e-12 AS s FROM x),
p AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) / (a.s * b.s) AS w FROM n a JOIN n b ON a.id <> b.id WHERE a.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM p)"""
_KNN = """, m AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY x DESC, dst) AS k FROM c)
SELECT least(src, dst) AS u, greatest(src, dst) AS v, round(max(x), 6) AS w FROM m WHERE k <= 10 GROUP BY 1, 2 HAVING max(x) > 0"""
_NODE_VECTORS = f"""names_ AS (SELECT {canonical_sql("id")} AS name, {canonical_sql("alias")} AS former FROM nodes),
former_ AS (SELECT former, min(name) AS node FROM names_ WHERE former IS NOT NULL AND name IS NOT NULL AND former NOT IN (SELECT name FROM names_ WHERE name IS NOT NULL) GROUP BY former),
usable_ AS (SELECT {canonical_sql("ids")} AS name, list_transform(emb, lambda e: CAST(e AS DOUBLE)) AS v, loaded_at, rec_id FROM node_embeddings
 WHERE len(emb) = {SIZE} AND len(list_filter(emb, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(emb, lambda e: e <> 0)) > 0),
last_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, rec_id DESC) AS k
 FROM (SELECT coalesce(node, name) AS id, v, loaded_at, rec_id FROM usable_ LEFT JOIN former_ ON former = name)),
node_vectors AS (SELECT id, v FROM last_ WHERE k = 1 AND id IN (SELECT name FROM names_))"""


def _node_cos(rows: str) -> str:
    return f"""n AS (SELECT id, v, sqrt(list_dot_product(v, v)) + 1e-12 AS s FROM {rows}),
    p AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) / (a.s * b.s) AS w FROM n a JOIN n b ON a.id <> b.id WHERE CAST(split_part(a.id, 'FMPP', 2) AS BIGINT) % {EVERY} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM p)"""


_HEAVIEST = f""", m AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY x DESC, dst) AS k FROM c)
SELECT least(src, dst) AS u, greatest(src, dst) AS v, round(max(x), 6) AS w FROM m WHERE k <= {HEAVIEST} GROUP BY 1, 2 HAVING max(x) > 0"""
_RESIDUES = "upper(regexp_replace(seq, '[^A-Za-z]', '', 'g'))"
_RECORDS = f"""raw AS (SELECT {canonical_sql("id")} AS id, {_RESIDUES} AS seq, rec_id FROM seqs),
records AS (SELECT * FROM (SELECT id, arg_max(seq, rec_id) AS seq FROM raw WHERE id IS NOT NULL AND seq IS NOT NULL GROUP BY id) WHERE length(seq) > 0)"""
_WINDOWS = f"""w AS (SELECT id, seq, unnest(range(0, CAST(greatest(0, ceil((length(seq) - {WINDOW}) / {STRIDE}::DOUBLE)) AS BIGINT) + 1)) AS no FROM records)"""
_PRIOR_ROWS = " UNION ALL ".join(f"SELECT {canonical_sql('u')} AS u, {canonical_sql('v')} AS v FROM {s}_pos_edges" for s in ("train", "val", "test"))
_PAIRS = f"prior AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM ({_PRIOR_ROWS}) WHERE u <> v)"
_ALPHABET = ", ".join(f"'{c}'" for c in scorers.ALPHABET)


def _quantiles(rows: str) -> str:
    return " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(x, {q}), 6) AS value FROM {rows}" for q in quality.QUANTILES)


SQL = {
    "cosine_topm": f"WITH {_COS} SELECT src, dst, round(w, 6) AS cos, rank FROM r WHERE rank <= 20",
    "knn_cos_pos": f"WITH {_COS}, c AS (SELECT src, dst, greatest(w, 0) AS x FROM r WHERE rank <= 20) {_KNN}",
    "knn_row_softmax": f"""WITH {_COS}, e AS (SELECT src, dst, exp((w - max(w) OVER (PARTITION BY src)) / 0.05) AS e FROM r WHERE rank <= 20),
     c AS (SELECT src, dst, e / (sum(e) OVER (PARTITION BY src) + 1e-12) AS x FROM e) {_KNN}""",
    "cosine_top500": f"WITH {_COS} SELECT src, dst, round(w, 6) AS cos, rank FROM r WHERE rank <= {NEAREST}",
    "knn_cos_pos_500": f"WITH {_COS}, c AS (SELECT src, dst, greatest(w, 0) AS x FROM r WHERE rank <= {NEAREST}) {_HEAVIEST}",
    "knn_row_softmax_500": f"""WITH {_COS}, e AS (SELECT src, dst, exp((w - max(w) OVER (PARTITION BY src)) / 0.05) AS e FROM r WHERE rank <= {NEAREST}),
     c AS (SELECT src, dst, e / (sum(e) OVER (PARTITION BY src) + 1e-12) AS x FROM e) {_HEAVIEST}""",
    "edge_split_held": f"""WITH {_NODE_VECTORS}, {_PAIRS}, held_ AS (SELECT * FROM prior WHERE u IN (SELECT id FROM node_vectors) AND v IN (SELECT id FROM node_vectors)),
     x AS (SELECT u, v, row_number() OVER (ORDER BY md5('0|' || u || '|' || v), u, v) AS k, count(*) OVER () AS n FROM held_)
     SELECT u, v, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM x""",
    "knn_nodes_cos_pos": f"WITH {_NODE_VECTORS}, {_node_cos('node_vectors')}, c AS (SELECT src, dst, greatest(w, 0) AS x FROM r WHERE rank <= {NEAREST}) {_HEAVIEST}",
    "knn_nodes_softmax": f"""WITH {_NODE_VECTORS}, {_node_cos('node_vectors')}, e AS (SELECT src, dst, exp((w - max(w) OVER (PARTITION BY src)) / 0.05) AS e FROM r WHERE rank <= {NEAREST}),
     c AS (SELECT src, dst, e / (sum(e) OVER (PARTITION BY src) + 1e-12) AS x FROM e) {_HEAVIEST}""",
    "node_norm_quantiles": f"WITH {_NODE_VECTORS}, n AS (SELECT sqrt(list_dot_product(v, v)) AS x FROM node_vectors) {_quantiles('n')}",
    "cos_top5_quantiles": f"WITH {_COS}, t AS (SELECT w AS x FROM r WHERE rank = 5) {_quantiles('t')}",
    "pair_surplus": f"""WITH {_RECORDS}, {_PAIRS}, j AS (SELECT u, v, 0 AS part, a.seq || 'XXXXXXXXXX' || b.seq AS s FROM prior JOIN records a ON a.id = u JOIN records b ON b.id = v),
     size_ AS (SELECT s, len(list_distinct(list_transform(range(1, greatest(1, length(s) - 2) + 1), lambda i: substr(s, i, 3)))) AS n FROM (SELECT s FROM j UNION SELECT seq FROM records))
     SELECT j.u AS src, j.v AS dst, CAST(x.n - y.n - z.n AS DOUBLE) AS w FROM j JOIN size_ x ON x.s = j.s JOIN records a ON a.id = u JOIN size_ y ON y.s = a.seq JOIN records b ON b.id = v JOIN size_ z ON z.s = b.seq""",
    "emb_unit": """WITH x AS (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings),
     n AS (SELECT id, v, sqrt(list_dot_product(v, v)) + 1e-12 AS s, unnest(range(0, len(v))) AS at_ FROM x) SELECT id, CAST(at_ AS INT) AS at, round(v[at_ + 1] / s, 6) AS x FROM n""",
    "emb_norm_quantiles": f"""WITH x AS (SELECT list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings),
     n AS (SELECT sqrt(list_dot_product(v, v)) AS x FROM x) {_quantiles("n")}""",
    "emb_finite_check": """WITH x AS (SELECT emb, coalesce(len(list_filter(emb, lambda e: e IS NULL OR isnan(e) OR isinf(e))), 0) AS bad FROM node_embeddings)
     SELECT count(*) AS n_rows, count(*) FILTER (emb IS NULL) AS n_null, count(*) FILTER (bad > 0) AS n_not_finite,
     count(*) FILTER (emb IS NOT NULL AND bad = 0 AND sqrt(coalesce(list_sum(list_transform(emb, lambda e: CAST(e AS DOUBLE) * e)), 0)) < 1e-6) AS n_near_zero FROM x""",
    "cos_top1_quantiles": f"WITH {_COS}, t AS (SELECT w AS x FROM r WHERE rank = 1) {_quantiles('t')}",
    "rank_corr": f"""WITH x AS (SELECT rec_id, {_RESIDUES} AS s FROM seqs WHERE seq IS NOT NULL), y AS (SELECT rec_id, length(s) AS a, length(s) - length(replace(s, 'X', '')) AS b FROM x),
     z AS (SELECT row_number() OVER (ORDER BY a, rec_id) AS ra, row_number() OVER (ORDER BY b, rec_id) AS rb FROM y) SELECT round(corr(ra, rb), 6) AS correlation, count(*) AS n FROM z""",
    "seq_prepare": f"WITH {_RECORDS}, l AS (SELECT {canonical_sql('id')} AS id, min(pos) AS pos FROM nodes GROUP BY 1) SELECT id, pos, length(seq) AS size FROM l JOIN records USING (id)",
    "seq_missing": f"WITH {_RECORDS}, l AS (SELECT DISTINCT {canonical_sql('id')} AS id FROM nodes) SELECT id FROM l WHERE id NOT IN (SELECT id FROM records)",
    "seq_windows": f"WITH {_RECORDS}, {_WINDOWS} SELECT id, CAST(no AS INT) AS no, CAST(no * {STRIDE} AS INT) AS start, substr(seq, no * {STRIDE} + 1, {WINDOW}) AS window FROM w",
    "seq_length_bucket": f"WITH {_RECORDS} SELECT CAST(floor(length(seq) / 128::DOUBLE) * 128 AS BIGINT) AS bucket, count(*) AS n, max(length(seq)) AS longest FROM records GROUP BY 1",
    "seq_layout": f"""WITH {_RECORDS} SELECT id, md5(rtrim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS wrapped,
     md5(rtrim(regexp_replace(seq, '(.)', '\\1 ', 'g'), ' ')) AS spaced FROM records""",
    "seq_linker_pairs": f"""WITH {_RECORDS}, {_PAIRS}, j AS (SELECT u, v, a.seq || 'XXXXXXXXXX' || b.seq AS s FROM prior JOIN records a ON a.id = u JOIN records b ON b.id = v)
     SELECT u, v, length(s) AS size, md5(s) AS digest FROM j""",
    "pair_scored_jaccard": f"""WITH {_RECORDS}, {_PAIRS}, k AS (SELECT id, list_distinct(list_transform(range(1, greatest(1, length(seq) - 2) + 1), lambda i: substr(seq, i, 3))) AS k FROM records),
     b AS (SELECT u AS src, v AS dst FROM prior UNION ALL SELECT v, u FROM prior),
     s AS (SELECT src, dst, len(list_intersect(x.k, y.k)) AS c, len(x.k) + len(y.k) AS t FROM b JOIN k x ON x.id = src JOIN k y ON y.id = dst),
     j AS (SELECT src, dst, c / CAST(t - c AS DOUBLE) AS w FROM s), o AS (SELECT *, min(w) OVER (PARTITION BY src) AS lo, max(w) OVER (PARTITION BY src) AS hi FROM j),
     c AS (SELECT src, dst, CASE WHEN hi <= lo + 1e-12 THEN 0 ELSE (w - lo) / (hi - lo) END AS x FROM o) {_KNN}""",
    "pair_scored_candidates": f"""WITH {_RECORDS}, {_NODE_VECTORS}, {_node_cos("node_vectors WHERE id IN (SELECT id FROM records)")},
     k AS (SELECT id, list_distinct(list_transform(range(1, greatest(1, length(seq) - 2) + 1), lambda i: substr(seq, i, 3))) AS k FROM records),
     s AS (SELECT src, dst, len(list_intersect(x.k, y.k)) AS c, len(x.k) + len(y.k) AS t FROM r JOIN k x ON x.id = src JOIN k y ON y.id = dst WHERE rank <= {NEAREST}),
     j AS (SELECT src, dst, c / CAST(t - c AS DOUBLE) AS w FROM s), o AS (SELECT *, min(w) OVER (PARTITION BY src) AS lo, max(w) OVER (PARTITION BY src) AS hi FROM j),
     c AS (SELECT src, dst, CASE WHEN hi <= lo + 1e-12 THEN 0 ELSE (w - lo) / (hi - lo) END AS x FROM o) {_HEAVIEST}""",
    "pair_features": f"""WITH {_RECORDS}, {_PAIRS}, l AS (SELECT unnest([{_ALPHABET}]) AS c), q AS (SELECT id, c, length(seq) - length(replace(seq, c, '')) AS n FROM records, l),
     f AS (SELECT id, c, CAST(n / greatest(1, sum(n) OVER (PARTITION BY id)) AS FLOAT) AS x FROM q)
     SELECT u, v, round(sum(CAST(a.x AS DOUBLE) + b.x + abs(a.x - b.x) + a.x * b.x), 4) AS total, CAST(4 * count(*) AS INT) AS n
     FROM prior JOIN f a ON a.id = u JOIN f b ON b.id = v AND b.c = a.c GROUP BY u, v""",
    "embed_pooled": f"""WITH {_RECORDS}, {_WINDOWS}, p AS (SELECT id, no, substr(seq, no * {STRIDE} + 1, {WINDOW}) AS s FROM w),
     l AS (SELECT unnest([{_ALPHABET}]) AS c, unnest(range(0, 20)) AS at_), q AS (SELECT id, no, at_, length(s) - length(replace(s, c, '')) AS n FROM p, l),
     f AS (SELECT id, at_, n / greatest(1, sum(n) OVER (PARTITION BY id, no)) AS x FROM q) SELECT id, CAST(at_ AS INT) AS at, round(avg(CAST(CAST(x AS FLOAT) AS DOUBLE)), 5) AS x FROM f GROUP BY 1, 2""",
}
