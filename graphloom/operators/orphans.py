"""References to parent records that do not exist, kept up to date batch by batch.

State is a log of keyed changes: the versions of the parents seen so far (the parent index) and
what became of references that wait or that a deletion may still reopen.
``OrphanLedger.advance`` takes one batch, in whatever order rows are delivered: new references
probe the index, arriving parents resolve waiting references, and deletions (a parent seen
again with an end) reopen references that the parent had covered. Only references whose name
the batch touches are looked at again, and only changes are written. ``snapshot`` counts what waits.

Shapes
    references  tbl, rec_id, name, at       name NULL: names no parent, an orphan for good
    parents     pid, name, start, end       [start, end) is held; end NULL is for good

A reference with a time is an orphan unless a parent of its name holds at that time; one
without a time is an orphan only while no parent of its name was ever seen. A parent whose
start is NULL holds from the beginning. Rows seen twice count once by key.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skew
from ..runtime import cut

SALTS = 32
ALWAYS, FOREVER = "timestamp_ntz '0001-01-01'", "timestamp_ntz '9999-12-31'"
MONTH = "date_format(at, 'yyyy-MM') as month"


def held_spans(parents: DataFrame) -> DataFrame:
    """``(name, spans)``: the disjoint times at which a parent of that name holds, in order.

    Overlapping and repeated parents of a name are merged first, so that the array has one
    entry for each gap-free time, not for each delivery.
    """
    one = parents.where("name is not null").select(
        "name", F.coalesce("start", F.expr(ALWAYS)).alias("start"), F.coalesce("end", F.expr(FOREVER)).alias("end")
    ).where("end > start").distinct()
    order = Window.partitionBy("name").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(order)
    return (
        one.withColumn("island", island)
        .groupBy("name", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("name")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )


def probe(references: DataFrame, parents: DataFrame, hot: list | None = None, salts: int = SALTS) -> DataFrame:
    """``references`` with ``orphan``; references of the ``hot`` names are spread over ``salts`` tasks."""
    hot = skew.hot_keys(references, "name") if hot is None else hot
    index = skew.replicate(held_spans(parents), "name", hot, salts)
    holds = F.exists("spans", lambda s: (F.col("at") >= s["start"]) & (F.col("at") < s["end"]))
    return (
        references.withColumn("salt", skew.salt("name", F.col("rec_id"), hot, salts))
        .join(index, ["name", "salt"], "left")
        .withColumn("orphan", F.when(F.col("spans").isNull(), True).when(F.col("at").isNull(), False).otherwise(~holds))
        .drop("salt", "spans")
    )


@dataclass
class OrphanLedger:
    """Versions of parents, and states of references that wait or may be reopened; one table of changes a batch."""

    versions: list[DataFrame] = field(default_factory=list)
    changes: list[DataFrame] = field(default_factory=list)

    @property
    def batches(self) -> int:
        return len(self.versions)

    def log(self) -> DataFrame:
        """``(tbl, rec_id, name, at, orphan, known, batch)``; ``known`` is the state before the batch, NULL for a new reference."""
        return functools.reduce(DataFrame.unionByName, self.changes)

    def parents(self) -> DataFrame:
        """The last version of each parent."""
        every = functools.reduce(DataFrame.unionByName, self.versions)
        last = every.groupBy("pid", "name").agg(F.max_by(F.struct("start", "end"), "batch").alias("v"))
        return last.select("pid", "name", "v.start", "v.end")

    @property
    def pending(self) -> DataFrame:
        return _latest(self.log()).where("orphan").select("tbl", "rec_id", "name", "at")

    def advance(self, references: DataFrame, parents: DataFrame, settled: Column | None = None, hot: list | None = None, salts: int = SALTS) -> OrphanLedger:
        """The state after one batch.

        ``parents`` has new parents and new versions of known ones (by ``pid`` and ``name``; the
        batch's version replaces the known one; of several in a batch the one that ends first). ``settled``, of a
        reference's columns: no later batch ends a parent before the reference's time, so that it needn't
        be kept once it is resolved. ``hot``: names with a great share of the references, where known.
        """
        batch = F.lit(self.batches)
        hot = skew.hot_keys(references, "name") if hot is None else hot
        fresh = references.select("tbl", "rec_id", "name", "at", F.lit(None).cast("boolean").alias("known"))
        arrived = parents.groupBy("pid", "name").agg(F.min_by(F.struct("start", "end"), F.coalesce("end", F.expr(FOREVER))).alias("v"))
        arrived = cut(arrived.select("pid", "name", "v.start", "v.end", batch.alias("batch")))
        versions = [*self.versions, arrived]
        if self.changes:
            touched = arrived.select("name").where("name is not null")
            again = _latest(skew.semi_join(self.log(), touched, "name", F.col("rec_id"), hot, salts))
            fresh = fresh.unionByName(again.select("tbl", "rec_id", "name", "at", F.col("orphan").alias("known")))
        probed = probe(fresh, OrphanLedger(versions).parents(), hot, salts)
        done = F.col("at").isNull() | (F.lit(False) if settled is None else settled)
        kept = F.when(F.col("known").isNull(), F.col("orphan") | ~done).otherwise(F.col("known") != F.col("orphan"))
        changed = probed.where(kept).select("tbl", "rec_id", "name", "at", "orphan", "known", batch.alias("batch"))
        return OrphanLedger(versions, [*self.changes, cut(changed)])

    def snapshot(self) -> DataFrame:
        """``(tbl, month, n_orphans)`` of what waits; month is NULL for references without a time."""
        return count_by_month(self.pending)

    def snapshots(self) -> DataFrame:
        """``(batch, tbl, month, n_orphans)``: what waited after each batch.

        A reference adds one in the batch that makes it an orphan and takes one in the batch that resolves it.
        """
        step = F.when(F.col("orphan"), 1).when(F.col("known"), -1).otherwise(0)
        moved = self.log().groupBy("batch", "tbl", F.expr(MONTH)).agg(F.sum(step).alias("n"))
        later = moved.select(F.explode(F.sequence("batch", F.lit(self.batches - 1))).alias("batch"), "tbl", "month", "n")
        return later.groupBy("batch", "tbl", "month").agg(F.sum("n").alias("n_orphans")).where("n_orphans > 0")

    def events(self) -> DataFrame:
        """``(batch, n_new, n_resolved, n_reopened)``: new orphans, those that arrivals resolved, references that deletions reopened."""
        counts = {"n_new": "orphan and known is null", "n_resolved": "known and not orphan", "n_reopened": "orphan and not known"}
        return self.log().groupBy("batch").agg(*(F.count_if(F.expr(c)).alias(n) for n, c in counts.items()))


def _latest(log: DataFrame) -> DataFrame:
    """The last state of each reference."""
    last = log.groupBy("tbl", "rec_id").agg(F.max_by(F.struct("name", "at", "orphan"), "batch").alias("v"))
    return last.select("tbl", "rec_id", "v.name", "v.at", "v.orphan")


def count_by_month(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("tbl", F.expr(MONTH)).agg(F.count(F.lit(1)).alias("n_orphans"))


def in_batches(references: DataFrame, parents: DataFrame, clock: list, late: int = 1) -> OrphanLedger:
    """Plays whole tables through the ledger in the order of delivery, ``batch`` being a column of both.

    A parent comes with its batch and, where it has an end, again as a deletion: ``late`` batches after the first whose
    time in ``clock`` (one for each batch, rising) reaches the end, not before the parent
    itself, and at the latest with the last batch. So a reference is settled ``late`` batches after its time.
    """
    references, parents = cut(references), cut(parents)
    clock = [None if t is None else F.lit(str(t)).cast("timestamp_ntz") for t in clock]
    ledger, hot, last = OrphanLedger(), skew.hot_keys(references, "name"), len(clock) - 1
    reached = F.coalesce(*(F.when(F.col("end") <= t, F.lit(b)) for b, t in enumerate(clock) if t is not None), F.lit(last))
    parents = parents.withColumn("ends", F.greatest("batch", F.least(reached + late, F.lit(last))))
    for b in range(len(clock)):
        t = clock[b - late] if b >= late else None
        seen = parents.where((F.col("batch") == b) | ((F.col("ends") == b) & F.col("end").isNotNull()))
        seen = seen.withColumn("end", F.when(F.col("ends") <= b, F.col("end")))
        settled = F.lit(True) if b == last else F.lit(False) if t is None else F.col("at") <= t
        ledger = ledger.advance(references.where(F.col("batch") == b), seen, settled, hot)
    return ledger
