"""Problem 2: references to nodes that do not exist."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import orphans
from .tables import table

REFERENCE_COLUMNS = {
    "signal_parts": ("u", "written_at"),
    "node_embeddings": ("ids", "loaded_at"),
    "seeds": ("c0", "added_at"),
}
#: Deliveries that the tables are played through in; each has its share of every table, in the order of ``rec_id``.
BATCHES = 4
#: Deliveries after which a deletion is told of.
LATE = 2


def delivered(df: DataFrame) -> DataFrame:
    """``df`` with ``batch``, the delivery that its ``rec_id`` came with."""
    low, high = df.agg(F.min("rec_id"), F.max("rec_id")).first()
    if low is None:
        return df.withColumn("batch", F.lit(0))
    return df.withColumn("batch", F.expr(f"int((rec_id - {low}L) * {BATCHES} div {high - low + 1}L)"))


def clock(spark: SparkSession, folder: str) -> list:
    """For each delivery the latest time that part files written until then have; one row a delivery."""
    rows = delivered(table(spark, folder, "signal_parts").select("rec_id", "written_at"))
    latest = {r["batch"]: r["at"] for r in rows.groupBy("batch").agg(F.max("written_at").alias("at")).collect()}
    times = [max((latest[k] for k in range(b + 1) if latest.get(k)), default=None) for b in range(BATCHES)]
    return times


def node_references(spark: SparkSession, folder: str) -> DataFrame:
    """The ids that name something in the three tables, with their delivery; blank ones are no references."""
    parts = [
        ids.with_canonical(delivered(table(spark, folder, tbl).select(F.lit(tbl).alias("tbl"), "rec_id", ref, F.col(at).alias("at"))), name=ref)
        .where(F.col("name").isNotNull() | ~ids.is_blank(F.col(ref)))
        .select("tbl", "rec_id", "name", "at", "batch")
        for tbl, (ref, at) in REFERENCE_COLUMNS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def node_parents(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``nodes`` under each name of their node: its id and its former ids."""
    nodes = table(spark, folder, "nodes")
    rows = delivered(nodes.select("rec_id", "id", F.col("loaded_at").alias("start"), F.col("retired_at").alias("end")))
    held = ids.with_canonical(rows, name="id").select(F.col("rec_id").alias("pid"), "name", "start", "end", "batch")
    former = ids.former_ids(nodes).withColumnRenamed("name", "former")
    under_former = held.join(former, held["name"] == former["node"]).select("pid", F.col("former").alias("name"), "start", "end", "batch")
    return held.unionByName(under_former)


def ledger(spark: SparkSession, folder: str) -> orphans.OrphanLedger:
    return orphans.in_batches(node_references(spark, folder), node_parents(spark, folder), clock(spark, folder), LATE)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return ledger(spark, folder).pending.select("tbl", "rec_id")


def p2_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return ledger(spark, folder).snapshot()


def p2_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table and month after each delivery."""
    return ledger(spark, folder).snapshots()


def p2_events(spark: SparkSession, folder: str) -> DataFrame:
    """New, resolved and reopened orphans of each delivery."""
    return ledger(spark, folder).events()


QUERIES = {f.__name__: f for f in (p2_found, p2_monthly, p2_snapshots, p2_events)}

_CANONICAL = r"""CASE WHEN regexp_matches({0}, '^\s*([0-9]+\.)?FMPP[0-9]{{11}}(\.[0-9]+)?\s*$', 'i')
 THEN coalesce(nullif(regexp_extract({0}, '^\s*([0-9]+)\.FMPP', 1, 'i'), ''), '7701')
  || '.FMPP' || regexp_extract({0}, 'FMPP([0-9]{{11}})', 1, 'i') END"""


def canonical_sql(column: str) -> str:
    return _CANONICAL.format(column)


_ORPHANS = f"""
WITH refs AS (
 SELECT 'signal_parts' AS tbl, rec_id, u AS txt, written_at AS tm FROM signal_parts
 UNION ALL SELECT 'node_embeddings', rec_id, ids, loaded_at FROM node_embeddings
 UNION ALL SELECT 'seeds', rec_id, c0, added_at FROM seeds),
r AS (SELECT tbl, rec_id, tm, {canonical_sql("txt")} AS name FROM refs
 WHERE txt IS NOT NULL AND regexp_replace(txt, '\\s+', '', 'g') <> ''),
n AS (SELECT {canonical_sql("id")} AS name, {canonical_sql("alias")} AS former, loaded_at, retired_at FROM nodes),
former AS (SELECT former, min(name) AS node FROM n WHERE former IS NOT NULL AND name IS NOT NULL
 AND former NOT IN (SELECT name FROM n WHERE name IS NOT NULL) GROUP BY former),
held AS (SELECT name, loaded_at, retired_at FROM n
 UNION ALL SELECT f.former, n.loaded_at, n.retired_at FROM former f JOIN n ON n.name = f.node),
orphans AS (SELECT tbl, rec_id, tm FROM r WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.name = r.name
 AND (r.tm IS NULL OR (r.tm >= h.loaded_at AND (h.retired_at IS NULL OR r.tm < h.retired_at)))))
"""

_BATCH = f"(rec_id - min(rec_id) OVER ({{0}})) * {BATCHES} // (max(rec_id) OVER ({{0}}) - min(rec_id) OVER ({{0}}) + 1)"
_STATES = f"""
WITH refs AS (
 SELECT 'signal_parts' AS tbl, rec_id, u AS txt, written_at AS tm FROM signal_parts
 UNION ALL SELECT 'node_embeddings', rec_id, ids, loaded_at FROM node_embeddings
 UNION ALL SELECT 'seeds', rec_id, c0, added_at FROM seeds),
parted AS (SELECT *, CAST({_BATCH.format("PARTITION BY tbl")} AS INT) AS came FROM refs),
r AS (SELECT tbl, rec_id, tm, came, {canonical_sql("txt")} AS name FROM parted WHERE txt IS NOT NULL AND regexp_replace(txt, '\\s+', '', 'g') <> ''),
n AS (SELECT {canonical_sql("id")} AS name, {canonical_sql("alias")} AS former, loaded_at, retired_at, CAST({_BATCH.format("")} AS INT) AS came FROM nodes),
former AS (SELECT former, min(name) AS node FROM n WHERE former IS NOT NULL AND name IS NOT NULL
 AND former NOT IN (SELECT name FROM n WHERE name IS NOT NULL) GROUP BY former),
clock AS (SELECT b, (SELECT max(tm) FROM parted WHERE tbl = 'signal_parts' AND came <= b) AS t FROM range({BATCHES}) x(b)),
dated AS (SELECT *, greatest(came, least(coalesce((SELECT min(b) FROM clock WHERE t >= retired_at), {BATCHES - 1}) + {LATE}, {BATCHES - 1})) AS goes FROM n),
held AS (SELECT name, loaded_at, retired_at, came, goes FROM dated
 UNION ALL SELECT f.former, d.loaded_at, d.retired_at, d.came, d.goes FROM former f JOIN dated d ON d.name = f.node),
states AS (SELECT tbl, rec_id, tm, r.came, b, NOT EXISTS (SELECT 1 FROM held h WHERE h.name = r.name AND h.came <= b
  AND (r.tm IS NULL OR (r.tm >= h.loaded_at AND (h.retired_at IS NULL OR h.goes > b OR r.tm < h.retired_at)))) AS orphan
 FROM r, range({BATCHES}) x(b) WHERE b >= r.came),
moves AS (SELECT *, lag(orphan) OVER (PARTITION BY tbl, rec_id ORDER BY b) AS known FROM states)
"""

SQL = {
    "p2_snapshots": _STATES + "SELECT CAST(b AS INT) AS batch, tbl, strftime(tm, '%Y-%m') AS month, count(*) AS n_orphans FROM states WHERE orphan GROUP BY 1, 2, 3",
    "p2_events": _STATES + """SELECT CAST(b AS INT) AS batch, count(*) FILTER (orphan AND known IS NULL) AS n_new, count(*) FILTER (known AND NOT orphan) AS n_resolved,
     count(*) FILTER (orphan AND NOT known) AS n_reopened FROM moves GROUP BY 1""",
    "p2_found": _ORPHANS + "SELECT tbl, rec_id FROM orphans",
    "p2_monthly": _ORPHANS + "SELECT tbl, strftime(tm, '%Y-%m') AS month, count(*) AS n_orphans FROM orphans GROUP BY 1, 2",
}
