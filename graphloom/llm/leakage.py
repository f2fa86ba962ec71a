"""Evaluation texts that a corpus shows, whole or in a large part.

Winnowing: of each window of ``WINDOW`` consecutive hashes of ``GRAM`` words the smallest is a
fingerprint, so that every run of ``GRAM + WINDOW - 1`` equal words gives a common one.
Fingerprints that documents share with items lie close together where a passage is shown; such
regions are joined with the items by fingerprint, and the hits are extended to passages.
"""

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

GRAM, WINDOW = 6, 3
#: A passage shows so much of an item at least, and of its words so many may be changed.
COVER, CHANGED = 0.5, 0.125
#: Fingerprints of one region lie this many words apart at most; a region holds as many words on either side.
REACH = 24
#: Words at either end of a passage that may lie outside of its fingerprints.
SLACK = 10
#: Item fingerprints sent to the executors at once, 8 bytes each; more items are looked for in further passes.
AT_ONCE = 2_000_000
#: Characters of the texts whose words are held at once.
SLICE = 4_000_000
_SCRIPT = "぀-ヿ㐀-鿿가-힯"
_WORD = re.compile(rf"[{_SCRIPT}]|[^\W_{_SCRIPT}]+")
_UNICODE_ESCAPE = re.compile(r"\\+u([0-9a-fA-F]{4})")
_ESCAPE = re.compile(r"\\+[nrtbf]")
_ENTITY = re.compile(r"&(?:amp|lt|gt|quot|apos|nbsp|#\d+|#x[0-9a-f]+);", re.I)
_HIDDEN = re.compile("[­​-‍⁠﻿]")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str) -> list[str]:
    """The words a reader sees: no case, punctuation, marks, escapes or line ends; ideographs one by one."""
    if "\\" in text:
        if "\\u" in text:
            text = _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        text = _ESCAPE.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


def _slices(texts: pd.Series) -> Iterator[slice]:
    """Rows whose texts have up to ``SLICE`` characters together, but for one longer text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = zlib.crc32(word.encode(errors="surrogatepass"))
        return h


def fingerprints(texts: list[list[str]], hashes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, word position, hash)`` of the winnowed fingerprints of several texts at once."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    h = np.array([hashes[w] for t in texts for w in t], dtype=np.uint64)
    text = np.repeat(np.arange(len(texts)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    m = len(h) - GRAM + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.zeros(m, dtype=np.uint64)
    for j in range(GRAM):
        grams = grams * _BASE + h[j : m + j] + np.uint64(1)
    grams ^= grams >> np.uint64(29)
    grams *= _MIX
    grams ^= grams >> np.uint64(32)
    grams[text[:m] != text[GRAM - 1 :]] = np.iinfo(np.uint64).max  # over the end of a text
    padded = np.concatenate([grams, np.full(WINDOW - 1, np.iinfo(np.uint64).max, np.uint64)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    chosen = np.unique(windows.argmin(axis=1) + np.arange(m))
    chosen = chosen[(chosen < m)]
    chosen = chosen[text[chosen] == text[np.minimum(chosen + GRAM - 1, len(h) - 1)]]
    return text[chosen], chosen - starts[text[chosen]], grams[chosen].view(np.int64)


def _runs(at: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(begin, end, numbers)``: shared fingerprints that lie close together, with the words around them."""
    for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > REACH) + 1):
        yield max(0, int(at[run[0]]) - REACH), min(length, int(at[run[-1]]) + GRAM + REACH), run


def best_passage(shown: list[str], item: list[str]) -> float:
    """Share of ``item`` that its longest passage in ``shown`` covers, with up to ``CHANGED`` of the words changed."""
    blocks = [b for b in SequenceMatcher(None, shown, item, autojunk=False).get_matching_blocks() if b.size]
    best = 0
    for i, first in enumerate(blocks):
        changed = 0
        for k, last in enumerate(blocks[i:], i):
            if k > i:
                before = blocks[k - 1]
                changed += max(last.a - before.a - before.size, last.b - before.b - before.size)
            span = last.b + last.size - first.b
            if changed <= CHANGED * span + 1:
                best = max(best, span)
    return best / len(item) if item else 0.0


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``(key, item_key, cover)`` of the documents that show a passage of at least half an item.

    NULL, empty and blank texts show nothing and are no items. Every document and item counts by
    itself, copies included. Texts are read whole, without a shuffle; only regions that share
    fingerprints with items go on. Items come in passes of up to ``AT_ONCE`` fingerprints.
    """
    items = items.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    docs = corpus.select(F.col(f"`{key}`").alias("d"), F.col(f"`{text}`").alias("t")).where("t is not null")
    item_kind, doc_kind = items.schema["i"].dataType.simpleString(), docs.schema["d"].dataType.simpleString()

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in (b.iloc[s] for b in batches for s in _slices(b["t"])):
            split = [words(t) for t in batch["t"]]
            no, at, h = fingerprints(split, hashes)
            size = np.array([len(w) for w in split], dtype=np.int32)
            yield pd.DataFrame({"i": batch["i"].to_numpy()[no], "q": at, "h": h, "size": size[no]})

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [s.split(" ")[max(0, a - REACH) : b + GRAM + REACH] for s, a, b in zip(batch["shown"], batch["first"], batch["last"])]
            cover = [best_passage(shown, words(item)) for shown, item in zip(near, batch["item"])]
            out = batch[["d", "i"]].assign(cover=cover)
            yield out[out["cover"] >= COVER]

    marks = cut(items.mapInPandas(mark, f"i {item_kind}, q int, h long, size int"))
    total, shortest = marks.agg(F.count(F.lit(1)), F.coalesce(F.min("size"), F.lit(0))).first()
    passes = max(1, -(-total // AT_ONCE))
    parts = []
    for n in range(passes):
        own = marks.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == n) if passes > 1 else marks
        here = cut(_regions(docs, doc_kind, own, COVER * shortest - 2 * SLACK).withColumn("r", F.monotonically_increasing_id()))
        hits = here.select("r", F.explode(F.arrays_zip("h", "at")).alias("x")).select("r", "x.h", "x.at").join(F.broadcast(own), "h")
        span = F.max("q") - F.min("q") + GRAM
        near = hits.groupBy("r", "i").agg(span.alias("span"), F.max("size").alias("size"), F.min("at").alias("first"), F.max("at").alias("last"))
        near = near.where(F.col("span") >= COVER * F.col("size") - 2 * SLACK)
        parts.append(near.join(here.select("r", "d", "shown"), "r").join(items.withColumnRenamed("t", "item"), "i").select("d", "i", "item", "shown", "first", "last"))
    found = functools.reduce(DataFrame.unionByName, parts).mapInPandas(extend, f"d {doc_kind}, i {item_kind}, cover double")
    return found.groupBy("d", "i").agg(F.max("cover").alias("cover")).select(F.col("d").alias(key), F.col("i").alias(item_key), "cover")


def _regions(docs: DataFrame, kind: str, marks: DataFrame, least: float) -> DataFrame:
    """``(d, shown, h, at)``: words, shared fingerprints and their places of each region whose fingerprints span ``least`` words."""
    shared = np.unique(np.array([r[0] for r in marks.select("h").distinct().collect()], dtype=np.int64))
    sought = docs.sparkSession.sparkContext.broadcast(shared)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        known_ones = sought.value  # sorted
        for batch in (b.iloc[s] for b in batches for s in _slices(b["t"])):
            if len(hashes) > 1_000_000:
                hashes.clear()
            split = [words(t) for t in batch["t"]]
            no, at, h = fingerprints(split, hashes)
            known = known_ones[np.minimum(np.searchsorted(known_ones, h), len(known_ones) - 1)] == h if len(known_ones) else np.zeros(len(h), dtype=bool)
            no, at, h, rows = no[known], at[known], h[known], []
            ends = np.searchsorted(no, np.arange(len(split) + 1))
            for k in np.unique(no).tolist():
                own = slice(ends[k], ends[k + 1])
                for begin, end, run in _runs(at[own], len(split[k])):
                    if at[own][run[-1]] - at[own][run[0]] + GRAM >= least:
                        rows.append((batch["d"].iloc[k], " ".join(split[k][begin:end]), h[own][run], (at[own][run] - begin).astype(np.int32)))
            yield pd.DataFrame(rows, columns=["d", "shown", "h", "at"])

    return docs.mapInPandas(read, f"d {kind}, shown string, h array<long>, at array<int>")
