"""Queries that write the derived dataset in a format, read it back and return its boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import box, ordered
from tessera.model import AnnotationDataset
from tessera.plans.tables import WITH, derived
from tessera.sources import FORMATS
from tessera.storage import delete_folder, discard, new_folder, stored

#: Formats of few files whose readers find image sizes in the files themselves. Formats with a file for each image are covered by tests.
ROW_FORMATS = ("tfod", "udacity", "kaggle-wheat", "retinanet", "vott-csv", "via-csv", "hf", "sagemaker", "labelbox")
DOCUMENT_FORMATS = (
    "ir-json", "coco", "create-ml", "bdd100k", "v7-darwin", "label-studio", "scale-ai", "datumaro", "edge-impulse", "via", "vott-json", "openlabel", "cvat", "tfrecord", "wider-face",
)
TEXT_FORMATS = ("yolo-keras", "yolov4-pytorch")


def clean(ds: AnnotationDataset) -> AnnotationDataset:
    """What every writer takes: images with a size, and ordered boxes of known images and categories."""
    images = ds.images.where("width > 0 and height > 0").withColumn("date_captured", F.lit(None).cast("string"))
    a = ds.annotations.where(ordered(box())).withColumn("attributes", F.create_map().cast("map<string,string>"))
    a = a.join(images.select(F.col("id").alias("_i")), F.col("image_id") == F.col("_i"), "left_semi").join(ds.categories.select(F.col("id").alias("_c")), F.col("category_id") == F.col("_c"), "left_semi")
    # writers count and read it several times; none asks for places in the source
    return ds.changed(images=images, annotations=stored(a.withColumn("_ord", F.col("id"))))


def boxes_of(ds: AnnotationDataset) -> DataFrame:
    """Rows (file_name, label, xmin, ymin, xmax, ymax), rounded."""
    i = ds.images.select(F.col("id").alias("_i"), "file_name")
    c = ds.categories.select(F.col("id").alias("_c"), F.col("name").alias("label"))
    rows = ds.named
    if rows is None:
        rows = ds.annotations.join(i, F.col("image_id") == F.col("_i")).join(c, F.col("category_id") == F.col("_c"))
    # shares of an image come back with the last digits changed; halves of pixels are far from the rounding
    return rows.select("file_name", "label", *[F.round(x, 2).alias(n) for n, x in zip(box()._fields, box(), strict=True)])


def round_trip(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = new_folder(spark)
        f = FORMATS[name]
        ds = clean(derived(spark, sf_dir))
        f.write(ds, at)
        discard(ds.annotations)
        rows = boxes_of(f.read(spark, at))
        # where all is read from tables that the reader has stored, the files have served
        if not any(at.rsplit("/", 1)[-1] in x for x in rows.inputFiles()):
            delete_folder(at)
        return rows

    return run


def _sql(label: str = "c.name") -> str:
    return f"""{WITH} SELECT file_name, {label} AS label, round(xmin, 2) AS xmin, round(ymin, 2) AS ymin, round(xmax, 2) AS xmax, round(ymax, 2) AS ymax
        FROM annotations JOIN images i ON image_id = i.id JOIN categories c ON category_id = c.id WHERE width > 0 AND xmin <= xmax AND ymin <= ymax"""


def queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    one_class = {"kaggle-wheat": "'wheat_head'", "wider-face": "'face'"}
    return {f"roundtrip_{n.replace('-', '_')}": (round_trip(n), _sql(one_class.get(n, "c.name"))) for n in (*ROW_FORMATS, *DOCUMENT_FORMATS, *TEXT_FORMATS)}
