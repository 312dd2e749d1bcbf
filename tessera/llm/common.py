"""What the operators share: tables in the shared folder, checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, stored

__all__ = ["BLANKS", "BLANK_CLASS", "BROADCAST_ROWS", "components", "discard", "let", "small", "stored", "words_of"]

#: The characters that separate words, as in ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"

#: Rows up to which a table counts as small enough to broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows; else unchanged, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_CLASS))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and a join; a hub's
    neighbours are never gathered. Nodes without edges don't appear.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = None
    while True:
        before = now
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        star = now.join(low, "u")
        last, now = before, stored(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(last)
        if mark == was:
            break
        was = mark
    top = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(top).select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
