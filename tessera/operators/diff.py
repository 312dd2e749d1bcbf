"""Differences of two datasets by file name and id, or by greedy overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, iou, near
from tessera.model import AnnotationDataset, latest, numbered
from tessera.operators import crowded
from tessera.storage import stored

#: Pairs of boxes of one image and category that are held in one row; beyond, a grid finds the pairs.
ROW_PAIRS = 1_000_000
_FIELDS = ("xmin", "ymin", "xmax", "ymax")


def image_names(a: AnnotationDataset, b: AnnotationDataset) -> DataFrame:
    """Rows (file_name, side): 'shared', 'only_in_a' or 'only_in_b'."""
    x, y = a.images.select("file_name").distinct().withColumn("_a", F.lit(1)), b.images.select("file_name").distinct().withColumn("_b", F.lit(1))
    return x.join(y, "file_name", "full_outer").select("file_name", _side())


def category_names(a: AnnotationDataset, b: AnnotationDataset) -> DataFrame:
    x, y = a.categories.select("name").distinct().withColumn("_a", F.lit(1)), b.categories.select("name").distinct().withColumn("_b", F.lit(1))
    return x.join(y, "name", "full_outer").select("name", _side())


def _side():
    return F.when(F.col("_a").isNull(), "only_in_b").when(F.col("_b").isNull(), "only_in_a").otherwise("shared").alias("side")


def _named(ds: AnnotationDataset) -> DataFrame:
    """Annotations of known images with file and category names."""
    files = latest(ds.images.select("file_name", "id", "_ord"), "file_name").select("file_name", F.col("id").alias("_iid"))
    cats = latest(ds.categories.select("id", "name", "_ord")).select(F.col("id").alias("_cid"), F.col("name").alias("category"))
    rows = ds.annotations.join(files, F.col("image_id") == F.col("_iid")).join(cats, F.col("category_id") == F.col("_cid"), "left")
    return rows.select("file_name", "id", F.coalesce("category", F.concat(F.lit("<missing cat "), F.col("category_id").cast("string"), F.lit(">"))).alias("category"), *_FIELDS, "_ord")


def by_id(a: AnnotationDataset, b: AnnotationDataset) -> DataFrame:
    """Rows (file_name, id, side, change) of all annotations; change says what differs between shared ones, or is null.

    An id repeated within an image counts once, as its last row. Annotations of images that only
    one side has are that side's own.
    """

    def rows(ds: AnnotationDataset, mark: str) -> DataFrame:
        return _named(ds).groupBy("file_name", "id").agg(F.max_by(F.struct("category", *_FIELDS), "_ord").alias(mark))

    joined = rows(a, "a").join(rows(b, "b"), ["file_name", "id"], "full_outer")
    box_of = lambda s: Box(*[F.col(f"{s}.{f}") for f in _FIELDS])
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    change = F.concat_ws(", ", F.when(F.col("a.category") != F.col("b.category"), "category changed"), F.when(~near(box_of("a"), box_of("b")), "bbox changed"))
    side = F.when(F.col("a").isNull(), "only_in_b").when(F.col("b").isNull(), "only_in_a").otherwise("shared")
    return joined.select("file_name", "id", side.alias("side"), F.when(shared & (change != ""), change).alias("change"))


def by_overlap(a: AnnotationDataset, b: AnnotationDataset, threshold: float = 0.5) -> DataFrame:
    """Rows (file_name, category, shared, only_in_a, only_in_b): boxes matched greedily in a's order by intersection over union.

    Each box of a takes the free box of b with the greatest overlap, the first of equals, if it
    reaches the threshold. A group is one image and category: its boxes stand in arrays of one row,
    but for groups of more than ``ROW_PAIRS`` pairs, whose rows are the same by ``crowded``. There,
    boxes that aren't finite match nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies within 0 (excluded) and 1")

    keys = ["file_name", "category"]
    rows_a, rows_b = _named(a), _named(b)
    many = stored(rows_a.groupBy(*keys).agg(F.count("*").alias("n_a")).join(rows_b.groupBy(*keys).agg(F.count("*").alias("n_b")), keys).where(F.col("n_a").cast("double") * F.col("n_b") > ROW_PAIRS))
    if many.isEmpty():
        return _in_rows(rows_a, rows_b, threshold)
    names = many.select(*keys)
    hot = [numbered(rows.join(names, keys, "left_semi"), *keys, "_ord", name="n").select(*keys, "n", *_FIELDS) for rows in (rows_a, rows_b)]
    found = many.join(crowded.matched(crowded.pairs(*hot, keys, threshold), keys), keys, "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))
    return _in_rows(rows_a.join(names, keys, "left_anti"), rows_b.join(names, keys, "left_anti"), threshold).unionByName(found.select(*keys, "shared", *[(F.col(f"n_{x}") - F.col("shared")).alias(f"only_in_{x}") for x in "ab"]))


def _in_rows(rows_a: DataFrame, rows_b: DataFrame, threshold: float) -> DataFrame:
    """``by_overlap`` with each group's boxes in two arrays of one row."""

    def boxes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("file_name", "category").agg(F.array_sort(F.collect_list(F.struct("_ord", *_FIELDS))).alias(name))

    def of(row) -> Box:
        return Box(*[row[f] for f in _FIELDS])

    def take(free, x):
        # (overlap, minus place) of each free box; the largest is the best and, among equals, the first
        scored = F.transform("b", lambda y, i: F.struct(F.when(F.get(free, i), iou(of(x), of(y))).otherwise(-1.0).alias("s"), (-i).alias("i")))
        return F.aggregate(F.array(F.array_max(scored)), free, lambda was, best: F.when(best["s"] >= threshold, F.transform(was, lambda f, i: f & (i != -best["i"]))).otherwise(was))

    joined = boxes(rows_a, "a").join(boxes(rows_b, "b"), ["file_name", "category"], "full_outer")
    free = F.aggregate("a", F.transform("b", lambda y: F.lit(True)), take)
    matched = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.size(F.filter(free, lambda f: ~f))).otherwise(0).cast("long")
    sized = joined.select("file_name", "category", matched.alias("shared"), F.when(F.col("a").isNull(), 0).otherwise(F.size("a")).cast("long").alias("n_a"), F.when(F.col("b").isNull(), 0).otherwise(F.size("b")).cast("long").alias("n_b"))
    return sized.select("file_name", "category", "shared", (F.col("n_a") - F.col("shared")).alias("only_in_a"), (F.col("n_b") - F.col("shared")).alias("only_in_b"))


def totals(rows: DataFrame) -> DataFrame:
    """Counts (shared, only_in_a, only_in_b, modified) of rows from ``by_id``."""
    n = lambda s: F.count_if(F.col("side") == s).alias(s)
    return rows.agg(n("shared"), n("only_in_a"), n("only_in_b"), F.count_if(F.col("change").isNotNull()).alias("modified"))


def require_unique_names(ds: AnnotationDataset) -> None:
    twice = ds.images.groupBy("file_name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"image file name occurs twice: {twice[0]['file_name']}")
