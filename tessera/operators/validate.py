"""Data quality rules: one row for each issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import area, box, finite, outside
from tessera.model import AnnotationDataset, latest

#: Severities of the codes.
SEVERITY = {
    "DuplicateImageId": "error", "InvalidImageDimensions": "error", "EmptyFileName": "warning", "DuplicateCategoryId": "error",
    "EmptyCategoryName": "warning", "DuplicateCategoryName": "warning", "DuplicateAnnotationId": "error", "MissingImageRef": "error",
    "MissingCategoryRef": "error", "BBoxNotFinite": "error", "InvalidBBoxOrdering": "error", "InvalidBBoxArea": "warning", "BBoxOutOfBounds": "error",
}


def _issues(rows: DataFrame, kind: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """Each row checked once against all rules, its failures exploded."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), message.alias("message"))) for code, bad, message in rules])
    each = rows.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"))
    severity = reduce(lambda c, code: c.when(F.col("i.code") == code, SEVERITY[code]), [r[0] for r in rules], F)
    return each.select(severity.alias("severity"), F.col("i.code").alias("code"), F.lit(kind).alias("context"), "id", F.col("i.message").alias("message"))


def _seen_before(key: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy("_ord")) > 1


def image_issues(ds: AnnotationDataset) -> DataFrame:
    rows = ds.images.withColumn("_again", _seen_before("id"))
    return _issues(rows, "image", [
        ("DuplicateImageId", F.col("_again"), F.lit("image id was seen before")),
        ("InvalidImageDimensions", (F.col("width") == 0) | (F.col("height") == 0), F.format_string("dimensions are %dx%d", "width", "height")),
        ("EmptyFileName", F.col("file_name") == "", F.lit("file name is empty")),
    ])


def category_issues(ds: AnnotationDataset) -> DataFrame:
    rows = ds.categories.withColumn("_again", _seen_before("id")).withColumn("_named", _seen_before("name"))
    return _issues(rows, "category", [
        ("DuplicateCategoryId", F.col("_again"), F.lit("category id was seen before")),
        ("EmptyCategoryName", F.col("name") == "", F.lit("category name is empty")),
        ("DuplicateCategoryName", (F.col("name") != "") & F.col("_named"), F.concat(F.lit("name was seen before: "), F.col("name"))),
    ])


def annotation_issues(ds: AnnotationDataset, tolerance: float = 0.5) -> DataFrame:
    dims = latest(ds.images.select("id", "width", "height", "_ord")).select(F.col("id").alias("_iid"), "width", "height")
    cats = ds.categories.select(F.col("id").alias("_cid")).distinct()
    rows = ds.annotations.withColumn("_again", _seen_before("id"))
    rows = rows.join(dims, F.col("image_id") == F.col("_iid"), "left").join(cats, F.col("category_id") == F.col("_cid"), "left")
    b, fine = box(), finite(box())
    return _issues(rows, "annotation", [
        ("DuplicateAnnotationId", F.col("_again"), F.lit("annotation id was seen before")),
        ("MissingImageRef", F.col("_iid").isNull(), F.concat(F.lit("no image "), F.col("image_id").cast("string"))),
        ("MissingCategoryRef", F.col("_cid").isNull(), F.concat(F.lit("no category "), F.col("category_id").cast("string"))),
        ("BBoxNotFinite", ~fine, F.lit("a coordinate is not finite")),
        ("InvalidBBoxOrdering", fine & ((b.xmin > b.xmax) | (b.ymin > b.ymax)), F.lit("a minimum exceeds its maximum")),
        ("InvalidBBoxArea", fine & (area(b) <= 0), F.lit("area is not positive")),
        ("BBoxOutOfBounds", fine & F.col("_iid").isNotNull() & outside(b, F.col("width"), F.col("height"), tolerance), F.lit("box leaves the image")),
    ])


def validate(ds: AnnotationDataset) -> DataFrame:
    """Rows (severity, code, context, id, message) of all issues."""
    return image_issues(ds).union(category_issues(ds)).union(annotation_issues(ds))


def counts(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def passes(issues: DataFrame, strict: bool = False) -> bool:
    """Whether there is no error, nor with ``strict`` a warning."""
    bad = issues if strict else issues.where("severity = 'error'")
    return not bad.limit(1).count()
