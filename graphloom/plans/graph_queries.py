"""Queries over whole graphs: merging, weighing, mixing, ranking and scoring them.

The signal graph is ``signal_parts``; the prior graph weighs each pair by how many rows of the
positive edge tables name it. Ids are compared by canonical spelling.
"""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import diffusion, graphs, metrics, normalize, splits
from ..operators import edges as E
from ..runtime import cut
from ..streaming.merge_stream import merge_files
from .orphan_queries import canonical_sql
from .tables import table

#: Most rounds and tolerance, looked at every so many rounds; nodes of a list.
ROUNDS, TOLERANCE, EVERY, TOP = 500, 1e-10, 10, 200
SPLITS = ("train", "val", "test")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Directed rows of the part files with canonical ids; ``line_no`` is their order."""
    rows = table(spark, folder, "signal_parts").select("u", "v", "w", F.col("rec_id").alias("line_no"))
    return _canonical(rows).select("u", "v", "w", "line_no")


def _canonical(df: DataFrame) -> DataFrame:
    return ids.with_canonical(df, u="u", v="v").where("u is not null and v is not null")


def signal(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.merge_parts(parts(spark, folder))


def prior(spark: SparkSession, folder: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    rows = functools.reduce(DataFrame.unionByName, (table(spark, folder, f"{s}_pos_edges").select("u", "v") for s in splits))
    return E.merge_sum(_canonical(rows).withColumn("w", F.lit(1.0)))


def _directed(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest positive weight of each directed pair."""
    rows = E.positive(E.clean(parts(spark, folder)))
    return rows.groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(F.max("w").alias("w"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def edge_dedup_max(spark, folder):
    return E.merge_max(parts(spark, folder))


def merge_parts(spark, folder):
    return signal(spark, folder)


def stream_merge_parts(spark, folder):
    """As ``merge_parts``, read as a stream."""
    schema = "rec_id bigint, u string, v string, w double, part string, line_no bigint, written_at timestamp_ntz"
    prepare = lambda df: _canonical(df.select("u", "v", "w"))
    return merge_files(spark, schema, f"{folder}/signal_parts.parque[t]", f"merge-{spark.range(1).select(F.expr('uuid()')).first()[0]}", prepare)


def edge_last_weight(spark, folder):
    return E.last_of_pair(parts(spark, folder), "line_no")


def edge_filter_whitelist(spark, folder):
    known = table(spark, folder, "nodes").select(ids.canonical(F.col("id")).alias("id"))
    return E.within(E.positive(signal(spark, folder), 0.25), known)


def node_degree(spark, folder):
    return _rounded(E.degrees(signal(spark, folder)), "strength")


def edge_nodes(spark, folder):
    return E.endpoints(prior(spark, folder))


def prior_graph(spark, folder):
    return prior(spark, folder)


def norm_minmax_global(spark, folder):
    return _rounded(normalize.over_graph(prior(spark, folder), "minmax"), "w")


def norm_clip01(spark, folder):
    return _rounded(normalize.over_graph(E.clean(parts(spark, folder)), "clip01"), "w")


def norm_minmax_src(spark, folder):
    return _rounded(normalize.over_source(_directed(spark, folder), "minmax"), "w")


def norm_sigmoid_z_src(spark, folder):
    return _rounded(normalize.over_source(_directed(spark, folder), "sigmoid_z"), "w")


def norm_softmax_src(spark, folder):
    return _rounded(normalize.over_source(_directed(spark, folder), "softmax", temperature=0.1), "w")


def top_edges_src(spark, folder):
    """The 20 heaviest edges of each source as an undirected graph."""
    return graphs.from_candidates(_directed(spark, folder), 20)


def reweight_exp(spark, folder):
    return _rounded(graphs.reweight(prior(spark, folder), parts(spark, folder)), "w")


def reweight_linear(spark, folder):
    return _rounded(graphs.reweight(prior(spark, folder), parts(spark, folder), form="linear", norm="raw"), "w")


def gated_mix_exp(spark, folder):
    return _rounded(graphs.gated_mix(prior(spark, folder), parts(spark, folder), share=0.7), "w", digits=7)


def gated_mix_linear(spark, folder):
    return _rounded(graphs.gated_mix(prior(spark, folder), parts(spark, folder), share=0.5, form="linear", norm="clip01"), "w", digits=7)


def seeds(spark, folder):
    rows = table(spark, folder, "seeds").select(ids.canonical(F.col("c0")).alias("id"), "weight")
    return rows.where("id is not null")


def labels(spark, folder):
    """Nodes are positive if the test split joins them with another."""
    pairs = E.distinct_pairs(_canonical(table(spark, folder, "test_pos_edges").select("u", "v")))
    return E.endpoints(pairs).withColumn("value", F.lit(1.0))


def seed_vector(spark, folder):
    return _rounded(diffusion.seed_vector(seeds(spark, folder)), "p", digits=9)


def label_map(spark, folder):
    """Of the weights given to a seed the last by time decides."""
    rows = table(spark, folder, "seeds").select(ids.canonical(F.col("c0")).alias("id"), F.col("weight").alias("value"), "rec_id")
    return metrics.label_map(rows, "rec_id")


def trained(spark, folder):
    """The prior without the edges that labels come from."""
    return prior(spark, folder, ("train",))


def _graphs(spark, folder, *names):
    made = {
        "signal": lambda: signal(spark, folder),
        "prior": lambda: trained(spark, folder),
        "mix": lambda: graphs.gated_mix(trained(spark, folder), parts(spark, folder)),
        "reweight": lambda: E.merge_max(graphs.reweight(trained(spark, folder), parts(spark, folder))),
    }
    return functools.reduce(DataFrame.unionByName, (made[n]().withColumn("graph", F.lit(n)) for n in names))


def _scores(spark, folder, *names):
    """Scores to the tolerance."""
    return _rounded(diffusion.pagerank(_graphs(spark, folder, *names), seeds(spark, folder), 0.85, ROUNDS, TOLERANCE, EVERY), "score", digits=9)


def _seeds_and_labels(spark, folder):
    return diffusion.seed_vector(seeds(spark, folder)), metrics.label_map(labels(spark, folder))


def _candidates(spark, folder, *names):
    return metrics.candidates(_scores(spark, folder, *names), *_seeds_and_labels(spark, folder))


def _evaluation(spark, folder, *names):
    return metrics.evaluation(cut(_scores(spark, folder, *names)), *_seeds_and_labels(spark, folder), TOP)


def ppr_scores(spark, folder):
    return _scores(spark, folder, "signal").select("id", "score")


def ppr_scores_converged(spark, folder):
    return _scores(spark, folder, "signal", "prior")


def ppr_topk(spark, folder):
    return _candidates(spark, folder, "signal").orderBy(F.desc("score"), "id").limit(TOP).select("id", "score")


def pr_curve(spark, folder):
    rows = metrics.curve(_candidates(spark, folder, "prior"))
    return _rounded(rows.select("id", "rank", "tp", "precision", "recall"), "precision", "recall")


def auprc(spark, folder):
    return _rounded(metrics.summary(_candidates(spark, folder, "prior"), TOP).select("graph", "auprc"), "auprc")


METRICS = ("auprc", "precision_at_k", "recall_at_k", "enrich_factor_at_k")


def ranking_metrics(spark, folder):
    return _rounded(_evaluation(spark, folder, "signal"), *METRICS)


def eval_folder_summary(spark, folder):
    return _rounded(metrics.best_first(_evaluation(spark, folder, "signal", "prior", "mix", "reweight")), *METRICS)


def eval_folder_converged(spark, folder):
    """As ``eval_folder_summary``; both rank to the tolerance."""
    return eval_folder_summary(spark, folder)


def eval_by_precision(spark, folder):
    """The two graphs of the highest precision."""
    return metrics.by_metric(_rounded(_evaluation(spark, folder, "signal", "prior", "reweight"), *METRICS), "precision_at_k").limit(2)


def edge_split(spark, folder):
    return splits.edge_split(prior(spark, folder))


def node_split(spark, folder):
    return splits.node_split(prior(spark, folder))


def negative_pairs(spark, folder):
    return splits.negatives(prior(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        edge_dedup_max, merge_parts, stream_merge_parts, edge_last_weight, edge_filter_whitelist, node_degree, edge_nodes,
        prior_graph, norm_minmax_global, norm_clip01, norm_minmax_src, norm_sigmoid_z_src, norm_softmax_src, top_edges_src,
        reweight_exp, reweight_linear, gated_mix_exp, gated_mix_linear, seed_vector, label_map, ppr_scores, ppr_topk, pr_curve, auprc,
        ranking_metrics, eval_folder_summary, ppr_scores_converged, eval_folder_converged, eval_by_precision, edge_split, node_split, negative_pairs,
    )
}

_U, _V = canonical_sql("u"), canonical_sql("v")
_PARTS = f"parts AS (SELECT u, v, w, rec_id FROM (SELECT {_U} AS u, {_V} AS v, w, rec_id FROM signal_parts) WHERE u <> v AND w IS NOT NULL AND NOT isnan(w))"
_MERGED = _PARTS + ", merged AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM parts GROUP BY 1, 2)"
_SIGNAL = _MERGED + ", signal AS (SELECT * FROM merged WHERE w > 0)"


def _prior_of(*splits: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {_U} AS u, {_V} AS v FROM {s}_pos_edges" for s in splits)
    return f"prior AS (SELECT least(u, v) AS u, greatest(u, v) AS v, CAST(count(*) AS DOUBLE) AS w FROM ({rows}) WHERE u <> v GROUP BY 1, 2)"


_PRIOR, _TRAINED = _prior_of(*SPLITS), _prior_of("train")
_DIRECTED = _PARTS + ", d AS (SELECT u AS src, v AS dst, max(w) AS w FROM parts WHERE w > 0 GROUP BY 1, 2)"
_LAST = _PARTS + ", f AS (SELECT least(u, v) AS u, greatest(u, v) AS v, arg_max(w, rec_id) AS p FROM parts GROUP BY 1, 2)"
_SCALED = "s AS (SELECT u, v, CASE WHEN hi <= lo + 1e-12 THEN 0 ELSE (w - lo) / (hi - lo) END AS w FROM prior, (SELECT min(w) AS lo, max(w) AS hi FROM prior))"
_SEEDS = f"""given AS (SELECT {canonical_sql("c0")} AS id, CASE WHEN weight IS NULL OR isnan(weight) THEN 1 ELSE weight END AS w FROM seeds),
g AS (SELECT id, sum(w) AS s FROM given WHERE id IS NOT NULL AND w > 0 GROUP BY id)"""
_LABELS = f"""te AS (SELECT {_U} AS u, {_V} AS v FROM test_pos_edges),
labels AS (SELECT u AS id FROM te WHERE u <> v UNION SELECT v FROM te WHERE u <> v)"""


def _mix(scaled: str, factor: str, share: float, prior: str = _PRIOR) -> str:
    return f"""{_LAST}, {prior}, {scaled}, gated AS (SELECT s.u, s.v, {share} * s.w * {factor} AS w FROM s LEFT JOIN f USING (u, v)),
    b AS (SELECT * FROM gated UNION ALL SELECT least(u, v), greatest(u, v), {1 - share} * w FROM parts),
    mix AS (SELECT u, v, sum(w) AS w FROM b GROUP BY u, v HAVING sum(w) > 0)"""



def _rank_sql(relation: str) -> str:
    """Scores of each graph in ``relation``, to the tolerance, as it is looked at."""
    return f"""e AS (SELECT graph, u AS a, v AS b, w FROM {relation} UNION ALL SELECT graph, v, u, w FROM {relation}),
    o AS (SELECT graph, a, sum(w) AS o FROM e GROUP BY graph, a),
    t AS (SELECT e.graph, e.a, e.b, e.w / o.o AS share FROM e JOIN o ON e.a = o.a AND e.graph = o.graph),
    here AS (SELECT o.graph, g.id, g.s / sum(g.s) OVER (PARTITION BY o.graph) AS p FROM g JOIN o ON g.id = o.a),
    n AS (SELECT o.graph, o.a AS id, coalesce(here.p, 0) AS p, 1.0 / count(*) OVER (PARTITION BY o.graph) AS x FROM o LEFT JOIN here ON here.id = o.a AND here.graph = o.graph),
    r AS (SELECT 0 AS k, graph, id, CAST(x AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS before FROM n
     UNION ALL SELECT r.k + 1, t.graph, t.b, 0.85 * sum(r.x * t.share) + 0.15 * max(n.p), max(own.x) FROM r JOIN t ON r.id = t.a AND r.graph = t.graph
      JOIN n ON n.id = t.b AND n.graph = t.graph JOIN r own ON own.id = t.b AND own.graph = t.graph
      WHERE r.k < {ROUNDS} AND (r.k % {EVERY} <> 0 OR r.k = 0 OR r.graph IN (SELECT graph FROM r GROUP BY graph HAVING sum(abs(x - before)) >= count(*) * {TOLERANCE}))
      GROUP BY r.k, t.graph, t.b),
    ends AS (SELECT *, max(k) OVER (PARTITION BY graph) AS iterations FROM r),
    scores AS (SELECT graph, id, round(x, 9) AS score, iterations, sum(abs(x - before)) OVER (PARTITION BY graph) < count(*) OVER (PARTITION BY graph) * {TOLERANCE} AS converged
     FROM ends WHERE k = iterations)"""


_CANDIDATES = """cand AS (SELECT graph, id, score, CASE WHEN id IN (SELECT id FROM labels) THEN 1.0 ELSE 0.0 END AS y
 FROM scores WHERE id NOT IN (SELECT id FROM g)),
c AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY score DESC, id) AS rank,
 sum(y) OVER (PARTITION BY graph ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp, sum(y) OVER (PARTITION BY graph) AS pos FROM cand)"""
_SUMMARY = f"""SELECT graph, count(*) AS n_candidates, CAST(sum(y) AS BIGINT) AS n_pos_eval, round(sum(y * tp / rank) / sum(y), 6) AS auprc,
 round(sum(CASE WHEN rank <= {TOP} THEN y ELSE 0 END) / count(*) FILTER (rank <= {TOP}), 6) AS precision_at_k,
 round(sum(CASE WHEN rank <= {TOP} THEN y ELSE 0 END) / greatest(1, sum(y)), 6) AS recall_at_k,
 round(sum(CASE WHEN rank <= {TOP} THEN y ELSE 0 END) / count(*) FILTER (rank <= {TOP}) / (sum(y) / count(*)), 6) AS enrich_factor_at_k FROM c GROUP BY graph"""
_COUNTS = """counts AS (SELECT graph, count(*) AS n_nodes, count(*) FILTER (id IN (SELECT id FROM g)) AS n_seeds_in_graph, count(*) FILTER (id IN (SELECT id FROM labels)) AS n_pos_total,
 CAST(max(iterations) AS INT) AS iterations, bool_and(converged) AS converged FROM scores GROUP BY graph)"""
_EVALUATION = f"{_CANDIDATES}, {_COUNTS}, m AS (SELECT * FROM counts JOIN ({_SUMMARY}) USING (graph))"
_RANK_SIGNAL = f"WITH RECURSIVE {_SIGNAL}, {_SEEDS}, {_LABELS}, {_rank_sql("(SELECT 'signal' AS graph, * FROM signal)")}"
_ALL = """all_ AS (SELECT 'signal' AS graph, least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM parts WHERE w > 0 GROUP BY ALL UNION ALL SELECT 'prior', u, v, w FROM prior
 UNION ALL SELECT 'mix', u, v, w FROM mix UNION ALL SELECT 'reweight', u, v, w FROM reweight_ WHERE w > 0)"""
_REWEIGHTED = "reweight_ AS (SELECT s.u, s.v, s.w * exp(coalesce(f.p, 0)) AS w FROM s LEFT JOIN f USING (u, v))"
_RANK_PRIOR = f"WITH RECURSIVE {_TRAINED}, {_SEEDS}, {_LABELS}, {_rank_sql("(SELECT 'prior' AS graph, * FROM prior)")}"
_MIX = _mix(_SCALED, "exp(coalesce(f.p, 0))", 0.5, _TRAINED)
_RANK_ALL = f"WITH RECURSIVE {_MIX}, {_REWEIGHTED}, {_ALL}, {_SEEDS}, {_LABELS}, {_rank_sql('all_')}"
_TRIES = " UNION ALL ".join(
    f"""SELECT x.id AS u, y.id AS v FROM (SELECT id, row_number() OVER (ORDER BY md5('{2 * k}|' || id || '|' || u || '|' || v), id, u, v) AS k FROM ends) x
 JOIN (SELECT id, row_number() OVER (ORDER BY md5('{2 * k + 1}|' || id || '|' || u || '|' || v), id, u, v) AS k FROM ends) y USING (k)"""
    for k in range(4)
)
_SPLIT = "CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split"
_FOLDER = f"{_RANK_ALL}, {_EVALUATION} SELECT *, row_number() OVER (ORDER BY auprc DESC NULLS FIRST, recall_at_k DESC NULLS FIRST, graph) AS place FROM m"

SQL = {
    "edge_dedup_max": f"WITH {_MERGED} SELECT u, v, w FROM merged",
    "merge_parts": f"WITH {_SIGNAL} SELECT u, v, w FROM signal",
    "stream_merge_parts": f"WITH {_SIGNAL} SELECT u, v, w FROM signal",
    "edge_last_weight": f"WITH {_LAST} SELECT u, v, p AS w FROM f",
    "edge_filter_whitelist": f"WITH {_SIGNAL} SELECT u, v, w FROM signal WHERE w > 0.25 AND u IN (SELECT {canonical_sql('id')} FROM nodes) AND v IN (SELECT {canonical_sql('id')} FROM nodes)",
    "node_degree": f"WITH {_SIGNAL} SELECT id, count(*) AS degree, round(sum(w), 6) AS strength FROM (SELECT u AS id, w FROM signal UNION ALL SELECT v, w FROM signal) GROUP BY id",
    "edge_nodes": f"WITH {_PRIOR} SELECT u AS id FROM prior UNION SELECT v FROM prior",
    "prior_graph": f"WITH {_PRIOR} SELECT u, v, w FROM prior",
    "norm_minmax_global": f"WITH {_PRIOR}, {_SCALED} SELECT u, v, round(w, 6) AS w FROM s",
    "norm_clip01": f"WITH {_PARTS} SELECT u, v, round(least(greatest(w, 0), 1), 6) AS w FROM parts",
    "norm_minmax_src": f"""WITH {_DIRECTED}, x AS (SELECT *, min(w) OVER (PARTITION BY src) AS lo, max(w) OVER (PARTITION BY src) AS hi FROM d)
     SELECT src, dst, round(CASE WHEN hi <= lo + 1e-12 THEN 0 ELSE (w - lo) / (hi - lo) END, 6) AS w FROM x""",
    "norm_sigmoid_z_src": f"""WITH {_DIRECTED}, x AS (SELECT *, avg(w) OVER (PARTITION BY src) AS m, stddev_pop(w) OVER (PARTITION BY src) AS sd FROM d)
     SELECT src, dst, round(1 / (1 + exp(-(w - m) / (sd + 1e-12))), 6) AS w FROM x""",
    "norm_softmax_src": f"""WITH {_DIRECTED}, x AS (SELECT *, exp((w - max(w) OVER (PARTITION BY src)) / 0.1) AS e FROM d)
     SELECT src, dst, round(e / (sum(e) OVER (PARTITION BY src) + 1e-12), 6) AS w FROM x""",
    "top_edges_src": f"""WITH {_DIRECTED}, x AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM d)
     SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(w) AS w FROM x WHERE k <= 20 GROUP BY 1, 2""",
    "reweight_exp": f"WITH {_LAST}, {_PRIOR}, {_SCALED} SELECT s.u, s.v, round(s.w * exp(coalesce(f.p, 0)), 6) AS w FROM s LEFT JOIN f USING (u, v)",
    "reweight_linear": f"WITH {_LAST}, {_PRIOR} SELECT p.u, p.v, round(p.w * (1 + coalesce(f.p, 0)), 6) AS w FROM prior p LEFT JOIN f USING (u, v)",
    "gated_mix_exp": f"WITH {_mix(_SCALED, 'exp(coalesce(f.p, 0))', 0.7)} SELECT u, v, round(w, 7) AS w FROM mix",
    "gated_mix_linear": f"WITH {_mix('s AS (SELECT u, v, least(greatest(w, 0), 1) AS w FROM prior)', '(1 + coalesce(f.p, 0))', 0.5)} SELECT u, v, round(w, 7) AS w FROM mix",
    "seed_vector": f"WITH {_SEEDS} SELECT id, round(s / (SELECT sum(s) FROM g), 9) AS p FROM g",
    "label_map": f"""SELECT id, arg_max(CASE WHEN v > 0 AND NOT isnan(v) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, rec_id) AS y
     FROM (SELECT {canonical_sql("c0")} AS id, weight AS v, rec_id FROM seeds) WHERE id IS NOT NULL AND v IS NOT NULL GROUP BY id""",
    "ppr_scores": f"{_RANK_SIGNAL} SELECT id, score FROM scores",
    "ppr_topk": f"{_RANK_SIGNAL}, {_CANDIDATES} SELECT id, score FROM c ORDER BY rank LIMIT {TOP}",
    "pr_curve": f"{_RANK_PRIOR}, {_CANDIDATES} SELECT id, rank, CAST(tp AS DOUBLE) AS tp, round(tp / rank, 6) AS precision, round(tp / pos, 6) AS recall FROM c",
    "auprc": f"{_RANK_PRIOR}, {_CANDIDATES} SELECT graph, round(sum(y * tp / rank) / sum(y), 6) AS auprc FROM c GROUP BY graph",
    "ranking_metrics": f"{_RANK_SIGNAL}, {_EVALUATION} SELECT * FROM m",
    "eval_folder_summary": _FOLDER,
    "eval_folder_converged": _FOLDER,
    "eval_by_precision": f"{_RANK_ALL}, {_EVALUATION} SELECT * FROM m WHERE graph <> 'mix' ORDER BY precision_at_k DESC NULLS LAST, graph LIMIT 2",
    "ppr_scores_converged": f"{_RANK_ALL} SELECT graph, id, score, CAST(iterations AS INT) AS iterations, converged FROM scores WHERE graph IN ('signal', 'prior')",
    "negative_pairs": f"""WITH {_PRIOR}, ends AS (SELECT u, v, u AS id FROM prior UNION ALL SELECT u, v, v FROM prior), drawn AS ({_TRIES}),
     fresh AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM drawn WHERE u <> v), f AS (SELECT * FROM fresh ANTI JOIN prior USING (u, v)),
     x AS (SELECT u, v, row_number() OVER (ORDER BY md5('-1|' || u || '|' || v), u, v) AS k FROM f) SELECT u, v FROM x WHERE k <= (SELECT count(*) FROM prior)""",
    "edge_split": f"""WITH {_PRIOR}, x AS (SELECT u, v, row_number() OVER (ORDER BY md5('0|' || u || '|' || v), u, v) AS k, count(*) OVER () AS n FROM prior) SELECT u, v, {_SPLIT} FROM x""",
    "node_split": f"""WITH {_PRIOR}, nodes_ AS (SELECT u AS id FROM prior UNION SELECT v FROM prior),
     x AS (SELECT id, row_number() OVER (ORDER BY md5('0|' || id), id) AS k, count(*) OVER () AS n FROM nodes_), p AS (SELECT id, {_SPLIT} FROM x)
     SELECT prior.u, prior.v, a.split FROM prior JOIN p a ON a.id = u JOIN p b ON b.id = v WHERE a.split = b.split""",
}
