"""Cutting oversized sequences into overlapping pieces at natural boundaries.

Dynamic programming over boundary positions: the cheapest chain of cuts, where a cut costs by
how natural its place is and a piece by how far its size is from the even share.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LENGTH, OVERLAP = 1022, 254
#: Costs of a cut: at a stop mark, in a masked stretch, in a linker, and anywhere else, which is the last resort.
STOP, MASKED, LINKER, ELSEWHERE = 0.0, 0.2, 0.4, 50.0
#: What a piece that misses the even share by all of it costs.
IMBALANCE = 1.0
#: Cuts without a natural boundary lie on this grid.
GRID = 16
#: A masked stretch has so many X or lower-case residues, a linker so many residues of few kinds.
LONG = 8
_NOT_RESIDUE = re.compile(r"[^A-Za-z]+")
_HARD_MASK = re.compile(rf"[Xx]{{{LONG},}}")
_SOFT_MASK = re.compile(rf"[a-z]{{{LONG},}}")
#: A short unit that is repeated, such as GGGGSGGGGS or PPEKPPEK, or one residue again and again.
_REPEAT = re.compile(r"(?i)([a-z]{1,6}?)\1{2,}")
#: A run of residues that keep no fold.
_FLEXIBLE = re.compile(r"(?i)[gskeqp]{12,}")


def residues(seq: Column) -> Column:
    """The letters of ``seq``; everything else is layout or a mark."""
    return F.regexp_replace(seq, "[^A-Za-z]", "")


def boundaries(seq: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the residues of ``seq`` where it may be cut, in order, and the cost of each."""
    cost: dict[int, float] = {p: ELSEWHERE for p in range(GRID, length, GRID)}

    def offer(p: int, c: float) -> None:
        if 0 < p < length:
            cost[p] = min(c, cost.get(p, ELSEWHERE))

    marks, at = [], 0
    for mark in _NOT_RESIDUE.finditer(seq):
        marks.append((mark.start() - at, "*" in mark[0]))
        at += len(mark[0])
    for p, stop in marks:
        if stop:
            offer(p, STOP)
    letters = _NOT_RESIDUE.sub("", seq)
    soft = not letters.islower()  # all in lower case is a way to write, not a mask
    for pattern, c in ((_HARD_MASK, MASKED), *(((_SOFT_MASK, MASKED),) if soft else ()), (_REPEAT, LINKER), (_FLEXIBLE, LINKER)):
        for m in pattern.finditer(letters):
            if m.end() - m.start() >= LONG:
                for p in {m.start(), (m.start() + m.end()) // 2, m.end()}:
                    offer(p, c)
    places = np.array(sorted(cost), dtype=np.int64)
    return places, np.array([cost[p] for p in places])


def cuts(seq: str, length: int, longest: int, overlap: int) -> list[int]:
    """Ends of the pieces: the last is ``length``, each piece with its overlap has ``longest`` residues at most."""
    step = longest - overlap
    pieces = 1 + -(-max(0, length - longest) // step)
    if pieces == 1:
        return [length]
    share = (length - overlap) / pieces  # what a piece adds to what the ones before it cover
    places, cost = boundaries(seq, length)
    places, cost = np.append(places, length), np.append(cost, 0.0)
    best, via = np.full(len(places), np.inf), np.full(len(places), -1)
    first_at = np.searchsorted(places, places - step)
    for k, end in enumerate(places):
        if end <= longest and end > overlap:
            best[k] = cost[k] + IMBALANCE * ((end - overlap - share) / share) ** 2
        lo = first_at[k]
        if lo < k:
            total = best[lo:k] + IMBALANCE * ((end - places[lo:k] - share) / share) ** 2
            j = int(np.argmin(total))
            if total[j] + cost[k] < best[k]:
                best[k], via[k] = total[j] + cost[k], lo + j
    ends, k = [], len(places) - 1
    while k >= 0:
        ends.append(int(places[k]))
        k = via[k]
    return ends[::-1]


def split_oversized(df: DataFrame, key: str, seq: str, longest: int = MAX_LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """``(key, piece_no, n_pieces, start, end, piece)`` of each record with more than ``longest`` residues.

    Pieces have ``longest`` residues at most, cover the record, and each begins ``overlap``
    residues before the end of the one before it; ``start`` (included) and ``end`` (excluded)
    count residues. Records that are not oversized, NULL and empty ones among them, give no row.
    Every record counts by itself, repeated ones included. Records are cut one by one in Arrow
    batches, without a shuffle.
    """
    if not 0 <= overlap or overlap + GRID > longest:
        raise ValueError("the overlap has to leave room in a piece")
    long = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{seq}`").alias("s")).where(F.length(residues(F.col("s"))) > longest)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, s in zip(batch["k"], batch["s"]):
                letters, start = _NOT_RESIDUE.sub("", s), 0
                ends = cuts(s, len(letters), longest, overlap)
                for no, end in enumerate(ends):
                    rows.append((k, no, len(ends), start, end, letters[start:end]))
                    start = end - overlap
            yield pd.DataFrame(rows, columns=["k", "piece_no", "n_pieces", "start", "end", "piece"])

    kind = long.schema["k"].dataType.simpleString()
    out = long.mapInPandas(pieces, f"k {kind}, piece_no int, n_pieces int, start int, `end` int, piece string")
    return out.withColumnRenamed("k", key)
