"""Greedy overlap matching for images with many boxes of one category.

A grid finds the pairs that can overlap enough, without meeting every box with every other. Taking
boxes greedily in order is then a stable matching in which all boxes of b rank their suitors alike,
by a's order: in rounds each box of a asks for its best box left, and each box of b turns away all
later suitors than the first that asked. What is left of a group once it fits one task is matched there.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, iou
from tessera.storage import discard, stored

#: Pairs of one group that a task matches in one go.
FINISH = 1_000_000
_SIDES = ("xmin", "ymin", "xmax", "ymax")


def _box(prefix: str) -> Box:
    return Box(*[F.col(prefix + s) for s in _SIDES])


def _axis(low: str, high: str, base: float, threshold: float) -> tuple[Column, Column]:
    """A side's level of size, and the cells in which a box of a looks and a box of b stands.

    Sides of boxes that overlap by the threshold differ by one level at most. A cell is as wide as
    the greater level's longest side; ``up`` marks the cells of boxes of b that are a level above a's.
    Each pair of boxes meets in one cell.
    """
    size, centre = F.col(high) - F.col(low), F.col(low) / 2 + F.col(high) / 2
    level = F.floor(F.log(size) / math.log(base)).cast("int")

    def cell(at: Column, of: Column) -> Column:
        return F.floor(at / F.pow(F.lit(base), of + 1)).cast("long")

    def look(of: Column, up: bool) -> Column:
        reach = (size + F.pow(F.lit(base), of + 1)) / 2 * (1 - threshold + 1e-6)
        return F.transform(F.sequence(cell(centre - reach, of), cell(centre + reach, of)), lambda c: F.struct(of.alias("l"), F.lit(up).alias("up"), c.alias("c")))

    def stand(of: Column, up: bool) -> Column:
        return F.struct(of.alias("l"), F.lit(up).alias("up"), cell(centre, of).alias("c"))

    return F.concat(look(level, False), look(level + 1, True)), F.array(stand(level, False), stand(level + 1, False), stand(level, True))


def pairs(a: DataFrame, b: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Rows (keys, a, b, s) of the boxes (keys, n, xmin, ymin, xmax, ymax) that overlap by the threshold or more; a and b are their ``n``."""
    base = max(2.0, 1 / threshold) * 1.0001
    real = (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin"))
    for s in _SIDES:
        real &= F.abs(s) < float("inf")

    def placed(df: DataFrame, side: int, name: str) -> DataFrame:
        x, y = _axis("xmin", "xmax", base, threshold)[side], _axis("ymin", "ymax", base, threshold)[side]
        spread = df.where(real).select(*keys, F.col("n").alias(name), *[F.col(s).alias(f"{name}_{s}") for s in _SIDES], F.explode(x).alias("gx"), y.alias("gy"))
        return spread.withColumn("gy", F.explode("gy"))

    met = placed(a, 0, "a").join(placed(b, 1, "b"), [*keys, "gx", "gy"])
    return met.withColumn("s", iou(_box("a_"), _box("b_"))).where(F.col("s") >= threshold).select(*keys, "a", "b", "s")


def _greedy(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """One group's number of matches: suitors in order, each with the best box that is free."""
    rows = rows.sort_values(["a", "s", "b"], ascending=[True, False, True])
    served, taken = None, set()
    n = 0
    for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
        if a != served and b not in taken:
            served = a
            taken.add(b)
            n += 1
    return pd.DataFrame([[*(rows[k].iloc[0] for k in keys), n]], columns=[*keys, "shared"])


def matched(found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, shared): how many boxes of each group of ``pairs`` are matched."""
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "shared long"])
    left, done = stored(found), []
    while True:
        sizes = left.groupBy(*keys).agg(F.count("*").alias("size"))
        fits = left.join(sizes.where(F.col("size") <= FINISH).drop("size"), keys, "left_semi")
        done.append(stored(fits.groupBy(*keys).applyInPandas(lambda rows: _greedy(rows, keys), schema)))
        more = left.join(sizes.where(F.col("size") > FINISH), keys)
        best = more.groupBy(*keys, "a").agg(F.max_by("b", F.struct("s", -F.col("b"))).alias("b"))
        first = best.groupBy(*keys, "b").agg(F.min("a").alias("first"))
        kept = stored(more.join(first, [*keys, "b"], "left").where(F.col("first").isNull() | (F.col("a") <= F.col("first"))).drop("first"))
        # where nobody was turned away, each suitor that is left has a box of its own
        now = kept.groupBy(*keys).agg(F.count("*").alias("now"), F.first("size").alias("was"), F.count_distinct("a").alias("shared"))
        settled = stored(now.where(F.col("now") == F.col("was")).select(*keys, "shared"))
        done.append(settled)
        rest = stored(kept.drop("size").join(settled, keys, "left_anti"))
        discard(left, kept)
        left = rest
        if left.isEmpty():
            break
    discard(left)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
