"""The most similar vectors of every vector, by collision-counting hashing.

Two levels of directions keep the search local. A small sample of the vectors gives coarse
directions; a vector belongs to the few on which it projects farthest, the upper end of each
one's sorted array. What meets there is one task, whose own sample gives finer directions in the
same way. In each fine cell further single projections are sorted. Windows are centred on a query's
own projections; a vector that lies in enough of the windows (a collision count over the
threshold) is verified in double precision. Windows widen (virtual rehashing) until they reach
beyond the query's k-th best so far, which earlier cells of the task have told already. The best
of all tasks are ranked last.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skew
from ..runtime import cut

#: Coarse directions: the root of the vectors over this, so that placing a vector costs a root; directions of a vector.
PER_COARSE, COARSE_EACH = 160, 5
#: Vectors of a coarse cell on average at most; beyond that there are more directions. 20,480 hold 537 million vectors in 5 MB.
COARSE_CELL = 131_072
#: Vectors of a fine direction on average, and fine directions of a vector.
PER_FINE, FINE_EACH = 60, 4
#: Sorted projections in a cell, first half-width of a window, its growth, and the share of windows that have to collide.
PROJECTIONS, WIDTH, GROWTH, THRESHOLD = 16, 0.4, 1.8, 0.6
#: A window finds vectors up to this share of its half-width reliably.
REACH = 0.7
#: Two vectors farther apart than this are no better than any two.
FAR = 1.5
#: A larger coarse cell is divided into blocks of so many vectors at most, each pair of which is a task of its own.
BLOCK = 2 * COARSE_CELL
#: Places of a sorted array at which the set of the members before it is kept; windows are rounded outwards to them.
STEPS = 256
#: From this share of candidates on, a matrix product verifies them faster than one by one.
DENSE = 0.1
SALTS = 32
_AT_ONCE = 4096


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).combine_chunks()
    return pa.concat_arrays(chunks.chunks) if isinstance(chunks, pa.ChunkedArray) else chunks


def usable(vector: Column, size: int) -> Column:
    """Exactly ``size`` finite numbers, not all zero; never NULL."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Unit vectors in double precision; all are of one length."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that no square is lost
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _farthest(unit: np.ndarray, lines: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and direction of the ``each`` directions on which each row projects farthest."""
    each = min(each, len(lines))
    best = [np.argpartition(-(unit[at : at + _AT_ONCE] @ lines.T), each - 1, axis=1)[:, :each] for at in range(0, len(unit), _AT_ONCE)]
    return np.repeat(np.arange(len(unit)), each), np.concatenate(best).ravel()


def _sets_before(order: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit sets of the members before every ``step``-th place of each sorted array, and the step."""
    lines, members = order.shape
    step = max(1, -(-members // STEPS))
    place = np.empty((lines, members), dtype=np.int64)
    np.put_along_axis(place, order, np.arange(members)[None, :] // step + 1, axis=1)
    marks = np.zeros((lines, -(-members // step) + 1, -(-members // 64) * 64), dtype=bool)
    marks[np.arange(lines)[:, None], place, np.arange(members)[None, :]] = True
    return np.bitwise_or.accumulate(np.packbits(marks, axis=2, bitorder="little").view(np.uint64), axis=1), step


def _at_least(planes: list[np.ndarray], need: int) -> np.ndarray:
    """Bits whose count, given as one bit set per binary digit, is ``need`` or more."""
    more, same = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for i in reversed(range(len(planes))):
        if need >> i & 1:
            same = same & planes[i]
        else:
            more |= same & planes[i]
    return more | same


class _Search:
    """The running ``k`` best of every vector of a task."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int, side: np.ndarray | None = None) -> None:
        self.ids, self.unit, self.k, self.side = ids, unit, k, side
        self.lines = np.random.default_rng(0).standard_normal((unit.shape[1], PROJECTIONS))
        self.cosine = np.full((len(ids), k), -9.0)
        self.found = np.full((len(ids), k), -1, dtype=np.int64)
        self.searches, self.whole = 0, 0

    def distance(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * self.cosine[rows, -1]))

    def run(self) -> None:
        if len(self.ids) < 2:
            return
        seed = (self.ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        sample = np.argsort(seed, kind="stable")[: max(1, len(self.ids) // PER_FINE)]
        row, cell = _farthest(self.unit.astype(np.float32), self.unit[sample].astype(np.float32), FINE_EACH)
        order = np.argsort(cell, kind="stable")
        for members in np.split(row[order], np.flatnonzero(np.diff(cell[order])) + 1):
            self.cell(members)

    def cell(self, members: np.ndarray) -> None:
        """Looks for each member's neighbours among the members."""
        x, m = self.unit[members], len(members)
        table = np.ascontiguousarray((x @ self.lines).T)
        order = np.argsort(table, axis=1)
        arrays = np.take_along_axis(table, order, axis=1)
        before, step = _sets_before(order)
        need = int(np.ceil(PROJECTIONS * THRESHOLD))
        known = np.zeros((m, before.shape[2]), dtype=np.uint64)  # verified, or not to be
        known[np.arange(m), np.arange(m) >> 6] = np.uint64(1) << (np.arange(m) & 63).astype(np.uint64)
        if self.side is not None:
            own = self.side[members]
            sides = np.packbits(np.pad(own[None, :] == np.unique(own)[:, None], ((0, 0), (0, known.shape[1] * 64 - m))), axis=1, bitorder="little")
            known |= sides.view(np.uint64)[np.searchsorted(np.unique(own), own)]
        radius = self.distance(members) / REACH
        width, active = np.where(radius < FAR / REACH, radius, WIDTH), np.arange(m)
        self.searches += m
        while len(active):
            w = width[active]
            planes = [np.zeros((len(active), before.shape[2]), dtype=np.uint64) for _ in range(PROJECTIONS.bit_length())]
            covered = np.ones(len(active), dtype=bool)
            for p in range(PROJECTIONS):
                low = np.searchsorted(arrays[p], table[p, active] - w, "left")
                high = np.searchsorted(arrays[p], table[p, active] + w, "right")
                covered &= (low == 0) & (high == m)
                carry = before[p, -(-high // step)] ^ before[p, low // step]
                for i in range((p + 1).bit_length()):  # adds the window to the counts
                    planes[i], carry = planes[i] ^ carry, planes[i] & carry
            hit = _at_least(planes, need) & ~known[active]
            known[active] |= hit
            mask = np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little", count=m).view(bool)
            self.verify(members, x, active, mask)
            distance = self.distance(members[active])
            sure = distance <= REACH * w + 1e-9
            self.whole += int((covered & ~sure).sum())
            width[active] = np.where(distance < FAR, np.minimum(w * GROWTH, distance / REACH), w * GROWTH)
            active = active[~(sure | covered)]

    def verify(self, members: np.ndarray, x: np.ndarray, active: np.ndarray, mask: np.ndarray) -> None:
        bound = self.cosine[members[active], -1]
        if np.count_nonzero(mask) > DENSE * mask.size:
            product = x[active] @ x.T
            q, c = np.nonzero(mask & (product >= bound[:, None]))
            cosine = product[q, c]
        else:
            q, c = np.nonzero(mask)
            cosine = np.einsum("ij,ij->i", x[active[q]], x[c])
            better = cosine >= bound[q]
            q, c, cosine = q[better], c[better], cosine[better]
        if not len(q):
            return
        ids = self.ids[members[c]]
        order = np.lexsort((ids, -cosine, q))
        q, ids, cosine = q[order], ids[order], cosine[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        changed, to = np.unique(q[keep], return_inverse=True)
        rows = members[active[changed]]
        both = np.full((len(rows), 2 * self.k), -9.0)
        names = np.full((len(rows), 2 * self.k), -1, dtype=np.int64)
        both[:, : self.k], names[:, : self.k] = self.cosine[rows], self.found[rows]
        both[to, self.k + place[keep]], names[to, self.k + place[keep]] = cosine[keep], ids[keep]
        order = np.lexsort((-both, names), axis=1)  # a neighbour that another cell found, too
        both, names = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
        both[:, 1:][(names[:, 1:] == names[:, :-1])] = -9.0
        order = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.cosine[rows], self.found[rows] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, place = np.nonzero(self.cosine > -9.0)
        return self.ids[q], self.found[q, place], self.cosine[q, place]


def _directions(vectors: DataFrame, n: int) -> np.ndarray:
    """A sample of the vectors that is the same on each run."""
    wanted = int(max(1, np.ceil(np.sqrt(n / PER_COARSE)), n * COARSE_EACH // COARSE_CELL))
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").toArrow()
    return _matrix(_column(rows, "vector")).astype(np.float32)


def most_similar(df: DataFrame, key: str, vector: str, k: int = 10, size: int = 64) -> DataFrame:
    """``(key, neighbour, cosine, rank)``: the ``k`` most similar vectors of each vector, itself left out.

    Only usable vectors take part (see ``usable``). Similarity is the cosine in double precision;
    of equal ones the smaller key comes first. The search is approximate. Exact copies of a
    vector are searched once and their rows ranked afterwards, so that a group of copies
    of any size costs no pairs within it. ``key`` has to be unique and of an integer type. An
    empty input gives an empty result.
    """
    v = F.transform(f"`{vector}`", lambda x: (x + F.lit(0.0)).cast("float"))  # -0.0 is 0.0
    rows = df.where(usable(F.col(f"`{vector}`"), size)).select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("vector"))
    rows = cut(rows.withColumn("h", F.xxhash64("vector")))
    classes = cut(rows.groupBy("h", "vector").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")))
    found = cut(_ranked(_cell_neighbours(classes.select(F.col("head").alias("id"), "vector"), k), k))
    return _expand(_copies(rows, classes), found, k).select(F.col("id").alias(key), "neighbour", "cosine", "rank")


def _copies(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``(id, head)`` of the rows whose vector others have too; large classes are spread over tasks."""
    many = classes.where("n > 1").select("h", "vector", "head")
    hot = skew.hot_keys(rows, "h")
    many = skew.replicate(many, "h", hot, SALTS)
    return cut(rows.withColumn("salt", skew.salt("h", F.col("id"), hot, SALTS)).join(many, ["h", "vector", "salt"]).select("id", "head"))


def _ranked(df: DataFrame, k: int) -> DataFrame:
    once = df.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cell_neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """``(id, neighbour, cosine)``: the best of each coarse cell."""
    spark = vectors.sparkSession
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, cosine double")
    directions = spark.sparkContext.broadcast(_directions(vectors, n))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                _, cell = _farthest(_matrix(part.column("vector")).astype(np.float32), directions.value, COARSE_EACH)
                offsets = np.arange(part.num_rows + 1) * (len(cell) // part.num_rows)
                cells = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), cells], names=["id", "vector", "cells"])

    placed = cut(vectors.mapInArrow(assign, "id long, vector array<float>, cells array<int>"))
    # As many names as directions at most; cells over BLOCK vectors are few.
    sizes = placed.select(F.explode("cells").alias("cell")).groupBy("cell").count()
    crowded = {r["cell"]: -(-r["count"] // BLOCK) for r in sizes.where(F.col("count") > BLOCK).collect()}
    placed = placed.select("id", "vector", F.explode("cells").alias("cell"))
    blocks = F.lit(1)
    if crowded:
        blocks_of = spark.createDataFrame(list(crowded.items()), "cell int, blocks int")
        placed = placed.join(F.broadcast(blocks_of), "cell", "left")
        blocks = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = placed.select("cell", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "vector")

    def search(group: pa.Table) -> pa.Table:
        side = _column(group, "block").to_numpy() if group["a"][0].as_py() != group["b"][0].as_py() else None
        task = _Search(_column(group, "id").to_numpy(), _matrix(_column(group, "vector")), k, side)
        task.run()
        return pa.table(dict(zip(("id", "neighbour", "cosine"), task.result())))

    return tasks.groupBy("cell", "a", "b").applyInArrow(search, "id long, neighbour long, cosine double")


def _expand(copies: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Neighbour classes as neighbour rows, for every row of a class.

    The first ``k + 1`` rows of a class are enough for any list; they are found in salted
    subgroups first. A row's own class comes first, itself left out.
    """
    first = lambda df, by: df.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("no") <= k + 1)
    few = first(copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), ["head", "salt"])
    few = first(few, ["head"]).groupBy("head").agg(F.sort_array(F.collect_list("id")).alias("rows"))
    of = few.select(F.col("head").alias("neighbour"), "rows")
    near = found.join(of, "neighbour", "left").withColumn("rows", F.coalesce("rows", F.array("neighbour")))
    near = near.select(F.col("id").alias("head"), F.explode("rows").alias("neighbour"), "cosine")
    own = few.select("head", F.explode("rows").alias("neighbour"), F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("head").orderBy(F.desc("cosine"), "neighbour")
    best = near.unionByName(own).withColumn("no", F.row_number().over(order)).where(F.col("no") <= k + 1)
    best = best.join(few.select(F.col("head").alias("of_copies")), F.col("head") == F.col("of_copies"), "left")
    single = best.where("of_copies is null and no <= %d" % k).select(F.col("head").alias("id"), "neighbour", "cosine", F.col("no").alias("rank"))
    item = F.struct("no", "neighbour", "cosine")
    lists = best.where("of_copies is not null").groupBy("head").agg(F.sort_array(F.collect_list(item)).alias("list"))
    hot = skew.hot_keys(copies, "head")
    lists = skew.replicate(lists, "head", hot, SALTS)
    rest = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k)
    each = copies.withColumn("salt", skew.salt("head", F.col("id"), hot, SALTS)).join(lists, ["head", "salt"])
    each = each.select("id", F.posexplode(rest).alias("no", "x"))
    return single.unionByName(each.select("id", "x.neighbour", "x.cosine", (F.col("no") + 1).alias("rank")))
