"""Filters and samples. Draws come from MD5 of the seed and a row's key, so any partitioning gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import AnnotationDataset


def wanted_categories(ds: AnnotationDataset, names: list[str]) -> DataFrame:
    """Ids of the categories with these names (trimmed, exact); none found is an error."""
    asked = [n.strip() for n in names if n.strip()]
    ids = ds.categories.where(F.col("name").isin(asked)).select("id").distinct()
    if not ids.limit(1).count():
        raise ValueError(f"no such category: {', '.join(asked)}")
    return ids


#: Rows that a task of a join takes, about.
ROWS_A_TASK = 500_000


def _among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is among the only column of ``keys``.

    Large tables are dealt to a number of tasks by rows: ids compress so well that a number by bytes
    gives tasks of many millions. It is an inner join with distinct keys, as semi joins slip below the dealing.
    """
    keys = keys.toDF("_among").distinct()
    n = rows.count() // ROWS_A_TASK
    if n < 2:
        return rows.join(keys, F.col(key) == F.col("_among"), "left_semi")
    tasks = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, key).join(keys, F.col(key) == F.col("_among")).drop("_among")


def filter_categories(ds: AnnotationDataset, names: list[str], mode: str = "images") -> AnnotationDataset:
    """Keep what has to do with some categories.

    ``images`` keeps whole images that have one of them; ``annotations`` keeps their annotations
    and the images left with any. Categories stay; no names change nothing.
    """
    if not [n for n in names if n.strip()]:
        return ds
    ids = wanted_categories(ds, names).select(F.col("id").alias("_cid"))
    hits = ds.annotations.join(ids, F.col("category_id") == F.col("_cid"), "left_semi")
    images = _among(ds.images, "id", hits.select("image_id"))
    if mode == "annotations":
        return ds.changed(images=images, annotations=_among(hits, "image_id", images.select("id")))
    if mode != "images":
        raise ValueError(f"unknown mode: {mode}")
    return ds.changed(images=images, annotations=_among(ds.annotations, "image_id", images.select("id")))


def subset(ds: AnnotationDataset, ids: DataFrame) -> AnnotationDataset:
    """The images with these ids and their annotations; categories and licences stay."""
    keep = ids.select("id")
    return ds.changed(images=_among(ds.images, "id", keep), annotations=_among(ds.annotations, "image_id", keep))


def target(total: int, n: int | None = None, fraction: float | None = None) -> int:
    """How many of ``total`` to draw: exactly one of a number and a fraction."""
    if (n is None) == (fraction is None):
        raise ValueError("give a number or a fraction")
    if n is not None:
        if n <= 0:
            raise ValueError("the number is positive")
        return min(n, total)
    if not 0 < fraction <= 1:
        raise ValueError("the fraction lies within 0 (excluded) and 1")
    return max(1, min(total, math.ceil(total * fraction))) if total else 0


def digest(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("file_name")).cast("binary"))


def random(ds: AnnotationDataset, k: int, seed: int = 0) -> DataFrame:
    """Ids of ``k`` images, all alike."""
    return ds.images.select("id", "file_name", digest(seed).alias("_d")).orderBy("_d", "file_name", "id").limit(k).select("id")


def weights(ds: AnnotationDataset) -> DataFrame:
    """Rows (id, file_name, weight): an image's weight sums, over its distinct categories, one over the category's annotations."""
    freq = ds.annotations.groupBy("category_id").agg(F.count("*").alias("_f"))
    seen = ds.annotations.select("image_id", "category_id").distinct().join(freq, "category_id")
    of = seen.groupBy("image_id").agg(F.sum(1 / F.col("_f")).alias("_w"))
    return ds.images.select("id", "file_name").join(of, F.col("id") == F.col("image_id"), "left").select("id", "file_name", F.coalesce("_w", F.lit(0.0)).alias("weight"))


def stratified(ds: AnnotationDataset, k: int, seed: int = 0) -> DataFrame:
    """Ids of ``k`` images drawn by weight without replacement; weightless ones only when no others are left.

    Each image gets an exponential waiting time with its weight as rate; the first ``k`` come.
    """
    u = (F.conv(F.substring(digest(seed), 1, 13), 16, 10).cast("double") + 1) / float(2**52 + 1)
    rows = weights(ds).withColumn("_u", u)
    wait = F.when(F.col("weight") > 0, F.round(-F.log("_u") / F.nullif("weight", F.lit(0.0)), 9)).otherwise(F.col("_u"))
    return rows.withColumn("_wait", wait).orderBy((F.col("weight") > 0).cast("int").desc(), F.col("_wait"), "id").limit(k).select("id")


def sample(ds: AnnotationDataset, n: int | None = None, fraction: float | None = None, seed: int = 0, strategy: str = "random") -> AnnotationDataset:
    """A subset of the images; asking for all or more gives all."""
    total = ds.images.count()
    k = target(total, n, fraction)
    if k >= total:
        return ds
    draw = {"random": random, "stratified": stratified}.get(strategy)
    if draw is None:
        raise ValueError(f"unknown strategy: {strategy}")
    return subset(ds, draw(ds, k, seed))
