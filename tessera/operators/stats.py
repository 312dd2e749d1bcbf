"""Profile of a dataset: nine sections, each one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import area, box, finite, ordered, outside, valid_area
from tessera.model import AnnotationDataset, latest

TOP, TOLERANCE = 10, 0.5
ASPECTS = ("<0.5", "0.5-1", "1-2", "2-5", ">=5")


def labelled(ds: AnnotationDataset) -> DataFrame:
    """Annotations with ``label``: the category's name, or a stand-in that names the missing id."""
    names = latest(ds.categories.select("id", "name", "_ord")).select(F.col("id").alias("_cid"), F.col("name").alias("_label"))
    joined = ds.annotations.join(names, F.col("category_id") == F.col("_cid"), "left")
    return joined.withColumn("label", F.coalesce("_label", F.concat(F.lit("<missing cat "), F.col("category_id").cast("string"), F.lit(">")))).drop("_cid", "_label")


def sized(ds: AnnotationDataset) -> DataFrame:
    """Annotations with their image's ``width`` and ``height``; null where the image is missing."""
    dims = latest(ds.images.select("id", "width", "height", "_ord")).select(F.col("id").alias("_iid"), "width", "height")
    return ds.annotations.join(dims, F.col("image_id") == F.col("_iid"), "left")


def summary(ds: AnnotationDataset) -> DataFrame:
    a = ds.annotations.agg(F.count("*").alias("annotations"), F.countDistinct("image_id").alias("annotated_images"))
    i, c, n = (df.agg(F.count("*").alias(name)) for df, name in ((ds.images, "images"), (ds.categories, "categories"), (ds.licenses, "licenses")))
    return i.join(c).join(a).join(n).select("images", "categories", "annotations", "licenses", "annotated_images")


def labels(ds: AnnotationDataset, top: int = TOP) -> DataFrame:
    """The most frequent labels, with how many labels and annotations there are and how many annotations the rest have."""
    counts = labelled(ds).groupBy("label").agg(F.count("*").alias("count"))
    totals = counts.agg(F.count("*").alias("total_distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_annotations"))
    first = counts.orderBy(F.desc("count"), F.asc("label")).limit(top)
    shown = first.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("_shown"))
    return first.join(totals).join(shown).select("label", "count", "total_distinct", "total_annotations", (F.col("total_annotations") - F.col("_shown")).alias("other_count"))


def _n(flag: Column) -> Column:
    return F.count_if(flag)


def boxes(ds: AnnotationDataset, tolerance: float = TOLERANCE) -> DataFrame:
    b = box()
    found = F.col("_iid").isNotNull()
    w, h = b.xmax - b.xmin, b.ymax - b.ymin
    kept = lambda c: F.when(ordered(b), c)
    return sized(ds).agg(
        F.count("*").alias("total"), _n(finite(b)).alias("finite"), _n(ordered(b)).alias("ordered"), _n(finite(b) & found).alias("oob_checked"),
        _n(finite(b) & found & outside(b, F.col("width"), F.col("height"), tolerance)).alias("out_of_bounds"), _n(ordered(b) & (area(b) <= 0)).alias("degenerate_area"),
        _n(~found).alias("missing_image_ref"), F.min(kept(w)).alias("min_width"), F.max(kept(w)).alias("max_width"), F.min(kept(h)).alias("min_height"), F.max(kept(h)).alias("max_height"),
    )


def resolutions(ds: AnnotationDataset) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return ds.images.agg(
        *[zero(f(c)).alias(f"{n}_{c[0]}") for c in ("width", "height") for f, n in ((F.min, "min"), (F.max, "max"))],
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c[0]}") for c in ("width", "height")],
    )


def density(ds: AnnotationDataset) -> DataFrame:
    """Annotations for each image id; annotations without an image don't count."""
    counts = ds.annotations.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return ds.images.select("id").distinct().join(counts, "id", "left").agg(
        F.coalesce(F.min(n), F.lit(0)).alias("min_per_image"), F.coalesce(F.max(n), F.lit(0)).alias("max_per_image"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_per_image"), _n(n == 0).alias("zero_annotation_images"),
    )


def areas(ds: AnnotationDataset) -> DataFrame:
    b = box()
    good, a = valid_area(b), area(b)
    return ds.annotations.agg(_n(good & (a < 1024)).alias("small"), _n(good & (a >= 1024) & (a < 9216)).alias("medium"), _n(good & (a >= 9216)).alias("large"), _n(~good).alias("invalid"))


def aspects(ds: AnnotationDataset) -> DataFrame:
    """Rows (name, count, invalid) of the five buckets of width over height."""
    b = box()
    ratio = (b.xmax - b.xmin) / F.when(valid_area(b), b.ymax - b.ymin)
    limits = (0.5, 1, 2, 5)
    flags = [valid_area(b) & (ratio >= lo if lo is not None else F.lit(True)) & (ratio < hi if hi is not None else F.lit(True)) for lo, hi in zip((None, *limits), (*limits, None), strict=True)]
    one = ds.annotations.agg(*[_n(f).alias(f"n{i}") for i, f in enumerate(flags)], _n(~valid_area(b)).alias("invalid"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"n{i}").alias("count"), F.col("invalid").alias("invalid")) for i, n in enumerate(ASPECTS)])))


def by_category(ds: AnnotationDataset, top: int | None = TOP) -> DataFrame:
    b = box()
    a = F.when(valid_area(b), area(b))
    rows = labelled(ds).groupBy(F.col("label").alias("category")).agg(F.count("*").alias("annotations"), F.min(a).alias("min_area"), F.max(a).alias("max_area"), F.avg(a).alias("mean_area"))
    return rows.orderBy(F.desc("annotations"), F.asc("category")).limit(top) if top is not None else rows


def cooccurrence(ds: AnnotationDataset, top: int | None = TOP) -> DataFrame:
    """Pairs of labels by the number of images that have both. A label counts once for an image, so an image's pairs are bounded by its labels."""
    once = labelled(ds).select("image_id", "label").distinct()
    rows = once.select("image_id", F.col("label").alias("a")).join(once.select("image_id", F.col("label").alias("b")), "image_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("count"))
    return rows.orderBy(F.desc("count"), "a", "b").limit(top) if top is not None else rows


def profile(ds: AnnotationDataset, top: int = TOP, tolerance: float = TOLERANCE) -> dict[str, DataFrame]:
    """All sections by name."""
    return {
        "summary": summary(ds), "labels": labels(ds, top), "bboxes": boxes(ds, tolerance), "image_resolutions": resolutions(ds), "annotation_density": density(ds),
        "area_distribution": areas(ds), "aspect_ratios": aspects(ds), "per_category_bbox": by_category(ds, top), "cooccurrence_top_pairs": cooccurrence(ds, top),
    }

