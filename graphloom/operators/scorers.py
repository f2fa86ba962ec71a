"""Models as vectorized functions: what scores a pair and what encodes a sequence.

A scorer or encoder is anything that makes a column of columns. Those that call a model load it
once in a Python worker and work on Arrow batches; ``pandas_encoder`` makes one of a factory. The
deterministic ones here are expressions and serve where no model is installed.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


def kmers(seq: Column, k: int = 3) -> Column:
    """Distinct k-mers of ``seq``; a shorter sequence is its own."""
    last = F.greatest(F.lit(1), F.length(seq) - k + 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(seq, i, F.lit(k))))


def kmer_codes(seq: Column, k: int = 3) -> Column:
    """``kmers`` of the letters A to Z as numbers of two bytes, for ``k`` up to 3; no letter counts as 0."""
    letters = F.transform(F.split(seq, ""), lambda c: F.greatest(F.lit(0), F.ascii(c) - 64))
    last = F.greatest(F.lit(0), F.length(seq) - k)
    code = lambda a, i: sum((F.coalesce(F.get(a, i + j), F.lit(0)) * 27 ** (k - 1 - j) for j in range(k)), F.lit(0)).cast("short")
    # The letters as a lambda's argument are made once, not again for each place.
    return F.array_distinct(F.transform(F.array(letters), lambda a: F.transform(F.sequence(F.lit(0), last), lambda i: code(a, i)))[0])


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def pandas_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A vectorized encoder; ``load`` makes the model in each worker, which maps texts to rows of a matrix."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.tolist()).astype(np.float32)))

    return encode


def composition(seq: Column) -> Column:
    """Share of each residue of ``ALPHABET`` among all of them; stands in for an encoder. All 0 where there are none, as of NULL."""
    seq = F.coalesce(seq, F.lit(""))
    counts = F.array(*(F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit(""))) for c in ALPHABET))
    total = lambda c: F.greatest(F.lit(1), F.aggregate(c, F.lit(0), lambda s, x: s + x))
    # The counts as a lambda's argument are made once, not again for each share.
    return F.transform(F.array(counts), lambda c: F.transform(c, lambda x: (x / total(c)).cast("float")))[0]


composition_encoder = composition
