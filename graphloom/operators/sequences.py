"""Residue sequences as text columns."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINKER = "X"


def residues(seq: Column) -> Column:
    """Upper-case letters of ``seq``; layout and marks are dropped."""
    return F.upper(F.regexp_replace(seq, "[^A-Za-z]", ""))


def windows(df: DataFrame, key: str, seq: str, size: int, stride: int) -> DataFrame:
    """``(key, no, start, window)``: one window if the sequence fits, else windows every ``stride`` until one reaches the end.

    The last window may be short. NULL and empty sequences give no row.
    """
    rows = df.select(F.col(key), F.col(seq).alias("s")).where("length(s) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.length("s") - size) / F.lit(stride)).cast("int"))
    return rows.select(key, "s", F.explode(F.sequence(F.lit(0), last)).alias("no")).select(
        key, "no", (F.col("no") * stride).alias("start"), F.substr("s", F.col("no") * stride + 1, F.lit(size)).alias("window")
    )


def linked(a: Column, b: Column, length: int = 10) -> Column:
    """Two sequences as one, with a linker between them."""
    return F.concat(a, F.lit(LINKER * length), b)


def spaced(seq: Column) -> Column:
    """Residues with single blanks between them."""
    return F.regexp_replace(seq, "(?<=.)(?=.)", " ")


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def length_bucket(seq: Column, size: int = 128) -> Column:
    return (F.floor(F.length(seq) / size) * size).cast("long")


def last_of_id(records: DataFrame, order: str) -> DataFrame:
    """``(id, seq)``: of records with the same id the last by ``order``."""
    last = F.max_by("seq", order).alias("seq")
    return records.where("id is not null").groupBy("id").agg(last)


def mean_of_windows(encoded: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, vector)``: the unweighted mean of the vectors of a key, element by element.

    NULL vectors don't count; all others have the same length. One partial sum per key and task is shuffled.
    """
    means = encoded.where(F.col(vector).isNotNull()).groupBy(key).agg(Summarizer.mean(array_to_vector(vector)).alias("__mean"))
    return means.select(key, vector_to_array("__mean").alias(vector))


def required(listed: DataFrame, records: DataFrame) -> DataFrame:
    """``listed(id)`` with its sequences; fails, naming it, where one is missing."""
    joined = listed.join(records.select("id", "seq"), "id", "left")
    told = F.raise_error(F.concat(F.lit("no sequence: "), "id")).cast("string")
    return joined.withColumn("seq", F.coalesce("seq", told))
