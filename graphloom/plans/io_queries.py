"""Queries through the text formats: tables are written to the shared folder and read back."""

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import diffusion, metrics, ranking, sequences, splits
from ..operators import edges as E
from ..runtime import checkpoint_dir, cut
from ..sources import formats
from . import graph_queries as G
from . import vector_queries as V
from .orphan_queries import canonical_sql
from .tables import table


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/formats-{uuid.uuid4().hex}"


def _write(lines: DataFrame, path: str, *order) -> None:
    formats.write_lines(lines, "value", path, [F.col(c) for c in order])


def io_edges(spark, folder):
    """The merged signal as lines of six digits."""
    path = _folder(spark)
    formats.write_edges(G.signal(spark, folder), path)
    return formats.read_edges(spark, path, strict=True).select("u", "v", "w")


def io_edges_last(spark, folder):
    """One file for each part; of the rows of a pair the last counts, files in the order of their names."""
    path = _folder(spark)
    rows = table(spark, folder, "signal_parts").select("u", "v", "w", "part", "rec_id").where("part is not null")
    lines = ids.with_canonical(rows, u="u", v="v").select("part", "rec_id", F.concat_ws("\t", "u", "v", F.coalesce(F.col("w").cast("string"), F.lit("w"))).alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "rec_id").select("part", "value").write.partitionBy("part").text(path)
    return E.last_of_pair(formats.read_edges(spark, f"{path}/part=*"), "line_no")


def io_graphs(spark, folder):
    """A folder of two graphs, read with a list of nodes and a least weight."""
    path = _folder(spark)
    formats.write_edges(G.signal(spark, folder), f"{path}/signal.tsv")
    formats.write_edges(G.prior(spark, folder), f"{path}/prior.tsv")
    known = table(spark, folder, "nodes").select(ids.canonical(F.col("id")).alias("id"))
    return formats.read_graphs(spark, f"{path}/*.tsv", known, 0.25)


def io_evaluation(spark, folder):
    """A folder of edge files evaluated file by file, with a list of nodes; weights have six digits."""
    path = _folder(spark)
    formats.write_edges(G.signal(spark, folder), f"{path}/signal.tsv")
    formats.write_edges(G.trained(spark, folder), f"{path}/prior.tsv")
    known = table(spark, folder, "nodes").select(ids.canonical(F.col("id")).alias("id"))
    found = formats.read_graphs(spark, f"{path}/*.tsv", known)
    scores = diffusion.pagerank(found, G.seeds(spark, folder), 0.85, G.ROUNDS, G.TOLERANCE, G.EVERY).withColumn("score", F.round("score", 9))
    out = metrics.best_first(metrics.evaluation(cut(scores), *G._seeds_and_labels(spark, folder), G.TOP))
    return out.withColumns({c: F.round(c, 6) for c in G.METRICS})


def io_pairs(spark, folder):
    path = _folder(spark)
    rows = G.prior(spark, folder).select("u", F.concat_ws("\t", "u", "v").alias("value"))
    head = spark.range(1).select(F.lit("").alias("u"), F.lit("node_1\tnode_2").alias("value"))
    _write(rows.unionByName(head), path, "u", "value")
    return formats.read_pairs(spark, path)


def io_ids(spark, folder):
    """The listed nodes in their order, each with its place in the file."""
    path = _folder(spark)
    names = table(spark, folder, "nodes").select(ids.canonical(F.col("id")).alias("value")).where("value is not null").distinct()
    _write(names.withColumn("value", F.concat(F.lit(" "), "value", F.lit("  listed "))), path, "value")
    rows = formats.read_ids(spark, path, first_token=True)
    return ranking.ranked(rows, [F.asc("pos")]).select("id", F.col("rank").alias("at"))


def io_seeds(spark, folder):
    path = _folder(spark)
    lines = G.seeds(spark, folder).select(F.concat_ws("\t", "id", F.col("weight").cast("string")).alias("value"))
    _write(lines, path, "value")
    return diffusion.seed_vector(formats.read_seeds(spark, path)).withColumn("p", F.round("p", 9))


def io_labels(spark, folder):
    """Of several lines of an id the last decides."""
    path = _folder(spark)
    rows = table(spark, folder, "seeds").select(ids.canonical(F.col("c0")).alias("id"), "weight", "rec_id").where("id is not null")
    _write(rows.select("rec_id", F.concat_ws("\t", "id", F.coalesce(F.col("weight").cast("string"), F.lit("none"))).alias("value")), path, "rec_id")
    return metrics.label_map(formats.read_labels(spark, path), "line_no")


def io_lengths(spark, folder):
    path = _folder(spark)
    _write(V.records(spark, folder).select("id", F.length("seq").alias("value")), path, "id")
    rows = formats.read_lengths(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.max("length").alias("longest"))


def io_fasta(spark, folder):
    path = _folder(spark)
    formats.write_fasta(V.records(spark, folder), path)
    return formats.read_fasta(spark, path).select("id", F.length("seq").alias("size"), F.md5("seq").alias("digest"))


def io_fasta_empty(spark, folder):
    """Records as they are, those without a body as well, under their number."""
    path = _folder(spark)
    rows = table(spark, folder, "seqs").select(F.col("rec_id").cast("string").alias("id"), F.coalesce(sequences.residues(F.col("seq")), F.lit("")).alias("seq"))
    formats.write_fasta(rows, path)
    found = formats.read_fasta(spark, path, keep_empty=True)
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seq") == "").alias("n_empty"), F.sum(F.length("seq")).alias("residues"))


def io_table(spark, folder):
    path = _folder(spark)
    rows = table(spark, folder, "nodes").select(ids.canonical(F.col("id")).alias("string_id"), "pos").where("string_id is not null")
    rows.write.csv(path, sep="\t", header=True, nullValue="")
    found = formats.read_table(spark, path, ["string_id"])
    return found.groupBy("string_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("pos").cast("long")).alias("pos"))


def io_split(spark, folder):
    path = _folder(spark)
    formats.write_parts(splits.edge_split(G.prior(spark, folder)), "split", path)
    return spark.read.parquet(path).select("u", "v", "split")


def _summaries(spark, folder):
    """Degrees of three graphs, as a summary is laid out."""
    graphs = {"signal": G.signal(spark, folder), "prior": G.prior(spark, folder), "trained": G.trained(spark, folder)}
    every = functools.reduce(DataFrame.unionByName, (g.select(F.lit(n).alias("graph"), "u", "v", "w") for n, g in graphs.items()))
    ends = every.select("graph", F.explode(F.array("u", "v")).alias("id")).groupBy("graph", "id").agg(F.count(F.lit(1)).alias("degree"))
    sums = ends.groupBy("graph").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("degree").alias("most"), F.avg("degree").alias("mean"))
    return ranking.ranked(sums, [F.desc("n_nodes"), F.asc("graph")]).withColumnRenamed("rank", "place")


def io_summary(spark, folder):
    path = _folder(spark)
    formats.write_summary(_summaries(spark, folder), path)
    rows = formats.read_table(spark, path, ["graph", "n_nodes", "place"])
    long = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("graph", long("n_nodes"), long("most"), F.round(F.col("mean").cast("double"), 6).alias("mean"), long("place"))


def io_summary_json(spark, folder):
    path = _folder(spark)
    formats.write_summary_json(_summaries(spark, folder), path)
    rows = spark.read.schema("graph string, n_nodes long, most long, mean double, place long").json(path)
    return rows.select("graph", "n_nodes", "most", F.round("mean", 6).alias("mean"), "place")


QUERIES = {
    f.__name__: f
    for f in (io_edges, io_edges_last, io_graphs, io_evaluation, io_pairs, io_ids, io_seeds, io_labels, io_lengths, io_fasta, io_fasta_empty, io_table, io_split, io_summary, io_summary_json)
}

_LISTED = f"listed AS (SELECT {canonical_sql('id')} AS id, pos FROM nodes)"
_SIX = "CAST(printf('%.6g', w) AS DOUBLE) AS w"
_GRAPHS = f"""{G._SIGNAL}, {G._PRIOR}, {G._TRAINED.replace("prior AS", "trained AS")},
every AS (SELECT 'signal' AS graph, u, v FROM signal UNION ALL SELECT 'prior', u, v FROM prior UNION ALL SELECT 'trained', u, v FROM trained),
ends AS (SELECT graph, id, count(*) AS degree FROM (SELECT graph, u AS id FROM every UNION ALL SELECT graph, v FROM every) GROUP BY 1, 2),
sums AS (SELECT graph, count(*) AS n_nodes, max(degree) AS most, round(avg(degree), 6) AS mean FROM ends GROUP BY graph)"""
_SUMMARY = f"WITH {_GRAPHS} SELECT *, row_number() OVER (ORDER BY n_nodes DESC, graph) AS place FROM sums"

SQL = {
    "io_edges": f"WITH {G._SIGNAL} SELECT u, v, {_SIX} FROM signal",
    "io_edges_last": f"""WITH rows_ AS (SELECT {canonical_sql("u")} AS u, {canonical_sql("v")} AS v, w, part || '|' || lpad(CAST(rec_id AS VARCHAR), 12, '0') AS place FROM signal_parts)
     SELECT least(u, v) AS u, greatest(u, v) AS v, arg_max(w, place) AS w FROM rows_ WHERE u <> v AND w IS NOT NULL AND NOT isnan(w) AND place IS NOT NULL GROUP BY 1, 2""",
    "io_graphs": f"""WITH {G._SIGNAL}, {G._PRIOR}, {_LISTED}, both_ AS (SELECT 'signal' AS graph, u, v, {_SIX} FROM signal UNION ALL SELECT 'prior', u, v, {_SIX} FROM prior)
     SELECT * FROM both_ WHERE w > 0.25 AND u IN (SELECT id FROM listed) AND v IN (SELECT id FROM listed)""",
    "io_evaluation": f"""WITH RECURSIVE {G._SIGNAL}, {G._TRAINED}, {_LISTED}, both_ AS (SELECT 'signal' AS graph, u, v, {_SIX} FROM signal UNION ALL SELECT 'prior', u, v, {_SIX} FROM prior),
     files AS (SELECT * FROM both_ WHERE u IN (SELECT id FROM listed) AND v IN (SELECT id FROM listed)), {G._SEEDS}, {G._LABELS}, {G._rank_sql("files")}, {G._EVALUATION}
     SELECT *, row_number() OVER (ORDER BY auprc DESC NULLS FIRST, recall_at_k DESC NULLS FIRST, graph) AS place FROM m""",
    "io_pairs": f"WITH {G._PRIOR} SELECT u, v FROM prior",
    "io_ids": f"WITH {_LISTED} SELECT id, row_number() OVER (ORDER BY id) AS at FROM (SELECT DISTINCT id FROM listed WHERE id IS NOT NULL)",
    "io_seeds": G.SQL["seed_vector"],
    "io_labels": G.SQL["label_map"],
    "io_lengths": f"WITH {V._RECORDS} SELECT count(*) AS n, CAST(sum(length(seq)) AS DOUBLE) AS total, CAST(max(length(seq)) AS DOUBLE) AS longest FROM records",
    "io_fasta": f"WITH {V._RECORDS} SELECT id, length(seq) AS size, md5(seq) AS digest FROM records",
    "io_fasta_empty": f"""WITH x AS (SELECT coalesce({V._RESIDUES}, '') AS s FROM seqs)
     SELECT count(*) AS n, count(*) FILTER (s = '') AS n_empty, CAST(sum(length(s)) AS BIGINT) AS residues FROM x""",
    "io_table": f"WITH {_LISTED} SELECT id AS string_id, count(*) AS n, min(pos) AS pos FROM listed WHERE id IS NOT NULL GROUP BY id",
    "io_split": G.SQL["edge_split"],
    "io_summary": _SUMMARY,
    "io_summary_json": _SUMMARY,
}
