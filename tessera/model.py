"""The canonical model: images, categories and annotations as DataFrames, with a little about the dataset.

``_ord`` is each row's place in its source: any column that sorts. Boxes are always in pixels.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import stored

IMAGES = "id long, file_name string, width long, height long, license_id long, date_captured string, attributes map<string,string>, _ord long"
CATEGORIES = "id long, name string, supercategory string, _ord long"
ANNOTATIONS = "id long, image_id long, category_id long, xmin double, ymin double, xmax double, ymax double, confidence double, attributes map<string,string>, _ord long"
LICENSES = "id long, name string, url string"
INFO = ("name", "version", "description", "url", "year", "contributor", "date_created")


@dataclass(frozen=True)
class AnnotationDataset:
    """One dataset. ``info`` holds the fields of ``INFO`` that are known, and ``attributes``.

    ``named`` has the annotations' id, file_name, label and box, if a reader knows them without joining the tables.
    """

    images: DataFrame
    categories: DataFrame
    annotations: DataFrame
    licenses: DataFrame
    info: dict = field(default_factory=dict)
    named: DataFrame | None = None

    def with_views(self, prefix: str = "") -> AnnotationDataset:
        """Register the tables as temporary views, for SQL."""
        for name in ("images", "categories", "annotations", "licenses"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        return self

    def changed(self, **tables) -> AnnotationDataset:
        return replace(self, **({"named": None} | tables))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def completed(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` in order; missing ones are null, ``_ord`` keeps its type."""
    out = []
    for part in schema.replace("<string,string>", "#").split(", "):
        name, kind = part.replace("#", "<string,string>").split(" ", 1)
        out.append((F.col(name) if name == "_ord" else F.col(name).cast(kind)) if name in df.columns else F.lit(None).cast(kind).alias(name))
    return df.select(*[c.alias(p.split(" ")[0]) for c, p in zip(out, schema.replace("<string,string>", "").split(", "), strict=True)])


def dataset(images: DataFrame, categories: DataFrame, annotations: DataFrame, licenses: DataFrame | None = None, info: dict | None = None) -> AnnotationDataset:
    spark = images.sparkSession
    return AnnotationDataset(
        completed(images, IMAGES), completed(categories, CATEGORIES), completed(annotations, ANNOTATIONS),
        completed(licenses, LICENSES) if licenses is not None else empty(spark, LICENSES), info or {},
    )


def latest(df: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key: the last in source order wins, as in lookups."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), "_ord").alias("_last")).select(key, *[F.col("_last." + c).alias(c) for c in names])


def numbered(df: DataFrame, *order, name: str = "_n", start: int = 1, kept: list[str] | None = None) -> DataFrame:
    """Number rows ``start``, ``start`` + 1, ... in order, without gathering them in one task.

    Rows are range-partitioned, sorted and stored with their partition and their place in it, so
    that every later use sees the same partitions; only the partitions' sizes meet. The result has
    all columns, or those ``kept``.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    # the low bits of the id count rows within a partition
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_own": place})
    parts = stored(parts if kept is None else parts.select(*kept, "_p", "_own"))
    sizes = parts.groupBy("_p").agg(F.max("_own").alias("_last"))
    before = sizes.select(F.col("_p").alias("_q"), (F.sum(F.col("_last") + 1).over(Window.orderBy("_p")) - F.col("_last") - 1).alias("_before"))
    return parts.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, F.col("_own") + F.col("_before") + start).drop("_p", "_q", "_own", "_before")
