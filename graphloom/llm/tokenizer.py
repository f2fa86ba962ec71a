"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts up to a leaf's size are encoded as they are. A longer text is halved until its leaves are
small enough; leaves are encoded by any task, and joined again (tree concatenation): around each
join a growing window is encoded anew until it agrees with both sides. A join reads no more than half a leaf
on either side, so that all joins of a text are tasks of their own, and no task holds its
text. Where half a leaf is too little, as in one endless word, the text goes on with leaves four times as large.
"""

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a leaf at most.
LEAF = 16_384
#: Splits text before the merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places at which PATTERN splits whatever lies around: a letter, digit or mark with one of another kind,
#: or white space, behind it. An apostrophe before a letter may begin a contraction and is no such place.
_SURE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")
#: A window in which PATTERN surely doesn't split.
_SOLID = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}']+")
#: Tokens on either side of a join in the first window without a sure place.
_FIRST = 16


class Encoder:
    """The vocabulary in one Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), dtype=np.int32)

    def seam(self, left: np.ndarray, right: np.ndarray) -> tuple[int, np.ndarray, int] | None:
        """What a join changes: tokens off the left, tokens between, tokens off the right; None if it takes more to tell.

        ``left`` are the last tokens before the join and ``right`` the first after it.
        """
        # Whole characters; one that the outer end cuts is left out.
        tail, head = (self.bpe.decode_bytes(x.tolist()).decode(errors="ignore") for x in (left, right))
        chars, tokens = 64, _FIRST
        while chars < 2 * max(len(tail), len(head)):
            a, b = tail[-chars:], head[:chars]
            begin = [m.start() for m in _SURE.finditer(a)]
            end = _SURE.search(b)
            if begin and end:
                a, b = a[begin[-1] :], b[: end.start()]
                return self._count(left[::-1], len(a.encode())), self.encode(a + b), self._count(right, len(b.encode()))
            if tokens < min(len(left), len(right)) and (window := self._agreeing(left[-tokens:], right[:tokens])) is not None:
                return tokens, window, tokens
            chars, tokens = 2 * chars, 2 * tokens
        return None

    def _count(self, tokens: np.ndarray, size: int) -> int:
        """How many of ``tokens`` make up the first ``size`` bytes."""
        return int(np.searchsorted(np.cumsum(self.sizes[tokens[: size + 1]]), size)) + 1 if size else 0

    def _agreeing(self, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
        """The window's encoding if it is one unsplit run and begins and ends with the tokens that are there.

        A run of tokens is the encoding of its bytes if every two neighbours are that of theirs;
        with the outer tokens unchanged, the neighbours across the window's edges are ones that
        an encoding already has.
        """
        try:
            text = self.bpe.decode_bytes([*left, *right]).decode()
        except UnicodeDecodeError:
            return None
        if not _SOLID.fullmatch(text):
            return None
        window = self.encode(text)
        return window if window[0] == left[0] and window[-1] == right[-1] else None


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _as_list(each: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
    values = np.concatenate(each) if each else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``(key, ids)``: the token ids of each text, without special tokens.

    NULL and empty texts give an empty list; blank ones are encoded as they are, and strings of
    special tokens are ordinary text. Rows come out one by one, repeated keys included. Only
    texts of more than ``leaf`` characters are shuffled, as leaves. The vocabulary is read on the driver's
    side and sent to the executors.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(SparkFiles.get(name))
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), _as_list(ids)], names=["k", "ids"])

    short = rows.where(F.length("t") <= leaf).mapInArrow(whole, f"k {kind}, ids array<int>")
    # Few rows; keys may repeat, so that each text has a number of its own, fixed by the checkpoint.
    rest, out = cut(rows.where(F.length("t") > leaf).withColumn("d", F.monotonically_increasing_id())), short
    while not rest.isEmpty():
        leaves, seams = _leaves_and_seams(rest, name, leaf)
        open_ = cut(seams.where("off_left is null").select("d").distinct())
        ids = _assembled(leaves, seams).join(open_, "d", "left_anti")
        out = out.unionByName(rest.select("d", "k").join(ids, "d").select("k", "ids"))
        rest, leaf = cut(rest.join(open_, "d", "left_semi")), 4 * leaf
    return out.withColumnRenamed("k", key)


def _leaves_and_seams(texts: DataFrame, name: str, leaf: int) -> tuple[DataFrame, DataFrame]:
    """``(d, no, ids)`` of the leaves of ``d, t`` and ``(d, no, off_left, between, off_right)`` of the join before each but the first."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(SparkFiles.get(name))
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("no"), _as_list(ids)], names=["d", "no", "ids"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(SparkFiles.get(name))
        for batch in batches:
            found = [bpe.seam(np.asarray(x, dtype=np.int32), np.asarray(y, dtype=np.int32)) for x, y in zip(batch["left"], batch["right"])]
            parts = [(None, None, None) if x is None else x for x in found]
            told = pd.DataFrame(parts, columns=["off_left", "between", "off_right"], index=batch.index).astype({"off_left": "Int32", "off_right": "Int32"})
            yield pd.concat([batch[["d", "no"]], told], axis=1)

    n = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.length("t") / leaf)))).cast("int")
    parts = texts.select("d", "t", F.ceil(F.length("t") / n).cast("int").alias("size"), n.alias("n"))
    parts = parts.select("d", "t", "size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("no"))
    parts = parts.select("d", "no", F.substr("t", F.col("no") * F.col("size") + 1, F.col("size")).alias("t")).where("t <> ''")
    encoded = cut(parts.repartition("d", "no").mapInArrow(encode, "d long, no int, ids array<int>"))
    # A join may change the nearer half of a leaf's tokens, so that the joins at both ends of a leaf never meet.
    half = F.floor(F.size("ids") / 2).cast("int")
    right = encoded.where("no > 0").select("d", "no", F.slice("ids", F.lit(1), half).alias("right"))
    left = encoded.select("d", (F.col("no") + 1).alias("no"), F.slice("ids", half + 1, F.size("ids")).alias("left"))
    seams = right.join(left, ["d", "no"]).mapInPandas(join, "d long, no int, off_left int, between array<int>, off_right int")
    return encoded, cut(seams)


def _assembled(leaves: DataFrame, seams: DataFrame) -> DataFrame:
    """``(d, ids)`` of the leaves without what the joins take off, and of what the joins put between them."""
    before = seams.select("d", "no", "off_right", "between")
    after = seams.select("d", (F.col("no") - 1).alias("no"), "off_left")
    rows = leaves.join(before, ["d", "no"], "left").join(after, ["d", "no"], "left")
    first, last = F.coalesce("off_right", F.lit(0)), F.coalesce("off_left", F.lit(0))
    own = F.slice("ids", first + 1, F.greatest(F.lit(0), F.size("ids") - first - last))
    piece = F.concat(F.coalesce("between", F.array().cast("array<int>")), own)
    # The list of a text is one value of the result, whatever its length.
    pieces = F.sort_array(F.collect_list(F.struct("no", piece.alias("ids"))))
    return rows.groupBy("d").agg(F.flatten(F.transform(pieces, lambda x: x["ids"])).alias("ids"))
