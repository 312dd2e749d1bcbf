"""Crowded images match by grid and rounds as small ones do by arrays."""

import random

import pytest

from tessera.operators import crowded, diff
from test_operators import make

IMAGES, CATS = [(1, "a", 20, 20, 0), (2, "b", 20, 20, 1)], [(1, "x", None, 0), (2, "y", None, 1)]


def boxes(rng, n, span=8, side=7):
    out = []
    for i in range(n):
        x, y = rng.randrange(span), rng.random() * span
        out.append((i, rng.choice([1, 1, 2]), rng.choice([1, 2]), float(x), y, float(x + rng.randrange(-1, side)), y + rng.choice([0, 1, rng.random() * side, 40 * rng.random()]), None))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("threshold", "finish"), [(0.5, 1_000_000), (0.03, 20), (0.3, 0), (1.0, 0)])
def test_same_rows_as_in_arrays(spark, monkeypatch, threshold, finish):
    """Any threshold, odd boxes and copies; matched in one task, in rounds and then in a task, and in rounds alone."""
    rng = random.Random(finish)
    left = boxes(rng, 70)
    a, b = make(spark, IMAGES, CATS, left), make(spark, IMAGES, CATS, [*boxes(rng, 50), *[(100 + i, *x[1:]) for i, x in enumerate(left[:15])]])
    want = rows(diff.by_overlap(a, b, threshold))
    assert sum(r[2] for r in want) > 5
    monkeypatch.setattr(diff, "ROW_PAIRS", 200)
    monkeypatch.setattr(crowded, "FINISH", finish)
    assert rows(diff.by_overlap(a, b, threshold)) == want


def test_crowded_image(spark):
    """100,000 boxes of one category on one image, each moved by a little: all of them match."""
    from pyspark.sql import functions as F

    a, b = make(spark, IMAGES, CATS, []), make(spark, IMAGES, CATS, [])
    n, wide = 100_000, 400

    def grid(ds, off):
        x, y = (F.col("id") % wide) * 6.0 + off, F.floor(F.col("id") / wide) * 6.0 + off
        cols = [F.col("id"), F.lit(1).alias("image_id"), F.lit(1).alias("category_id"), x.alias("xmin"), y.alias("ymin"), (x + 10).alias("xmax"), (y + 10).alias("ymax"), F.lit(None).cast("double").alias("confidence"), F.create_map().cast("map<string,string>").alias("attributes"), F.col("id").alias("_ord")]
        return ds.changed(annotations=spark.range(n).select(*cols))

    assert rows(diff.by_overlap(grid(a, 0.0), grid(b, 0.5))) == [("a", "x", n, 0, 0)]
