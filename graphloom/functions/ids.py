"""Node ids that several tools spell differently.

A text names a node by taxon and eleven digits: ``7701.FMPP00000001234`` is the canonical
spelling. Case, blanks around the id and a version mark at its end mean nothing; a missing
taxon is 7701. Everything else that is not blank is malformed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew

DEFAULT_TAXON = "7701"
USUAL_PATTERN = r"^\d+\.FMPP\d{11}\z"
ID_PATTERN = r"(?i)^[\s ]*(?:(\d+)\.)?FMPP(\d{11})(?:\.\d+)?[\s ]*$"


def canonical(text: Column) -> Column:
    """Canonical spelling of the id in ``text``; NULL where it is malformed, blank or NULL."""
    taxon = F.regexp_extract(text, ID_PATTERN, 1)
    digits = F.regexp_extract(text, ID_PATTERN, 2)
    written = F.concat(F.when(taxon == "", F.lit(DEFAULT_TAXON)).otherwise(taxon), F.lit(".FMPP"), digits)
    return F.when(text.rlike(USUAL_PATTERN), text).when(digits != "", written)


def with_canonical(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with canonical ids as new columns, ``name=column``.

    They come out of a generator of one row, which filters on them are not moved below: each
    pattern is matched once a row, not again in every filter.
    """
    rest = [c for c in df.columns if c not in columns]
    made = F.struct(*(canonical(F.col(f"`{old}`")).alias(new) for new, old in columns.items()))
    return df.select(*(F.col(f"`{c}`") for c in rest), F.inline(F.array(made)))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and blank texts; never NULL."""
    return F.coalesce(F.regexp_replace(text, r"[\s ]+", "") == "", F.lit(True))


def former_ids(nodes: DataFrame) -> DataFrame:
    """``(name, node)`` of each former id in ``nodes.alias``; one row per name.

    A former id that is itself the id of a node stays that node and is left out. Where two
    nodes claim a former id, the smaller id has it.
    """
    named = with_canonical(nodes.select("id", "alias"), name="alias", node="id").select("name", "node")
    held = named.where("node is not null").select(F.col("node").alias("name")).distinct()
    return (
        named.where("name is not null and node is not null")
        .groupBy("name")
        .agg(F.min("node").alias("node"))
        .join(held, "name", "left_anti")
    )


#: A table of former ids of up to so many rows, some 20 MB, is sent to all executors.
BROADCAST_ROWS = 200_000


def resolve(df: DataFrame, columns: list[str], former: DataFrame, salts: int = 32) -> DataFrame:
    """``df`` with the canonical ids in ``columns`` replaced by the nodes that they are former ids of.

    The former ids are broadcast where a count shows that they are few; otherwise each column
    is joined by shuffle, with hot ids spread over ``salts`` tasks.
    """
    small = former.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for c in columns:
        names = former.select(F.col("name").alias("__name"), F.col("node").alias("__node"))
        if small:
            df = df.join(F.broadcast(names), F.col(c) == F.col("__name"), "left")
        else:
            hot = skew.hot_keys(df, c)
            names = skew.replicate(names, "__name", hot, salts, "__salt")
            left = df.withColumn("__by", skew.salt(c, F.monotonically_increasing_id(), hot, salts))
            df = left.join(names, (F.col(c) == F.col("__name")) & (F.col("__by") == F.col("__salt")), "left").drop("__by", "__salt")
        df = df.withColumn(c, F.coalesce("__node", c)).drop("__name", "__node")
    return df
