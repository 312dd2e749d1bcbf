"""What a conversion would drop: all counters in a few aggregates, then a table of rules for each target."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import INFO, AnnotationDataset


@dataclass(frozen=True)
class Target:
    """What a format can't hold. ``attributes`` and ``image_attributes``: None if they aren't looked at, else the keys that stay (a trailing * is a prefix)."""

    info: bool = True
    info_keys: tuple[str, ...] = ()
    licenses: bool = True
    image_fields: bool = True
    supercategory: bool = True
    confidence: bool = True
    attributes: tuple[str, ...] | None = ()
    image_attributes: tuple[str, ...] | None = None
    unannotated: bool = False
    unused: bool = False
    collapse: bool = False
    sparse: tuple[str, ...] = ()
    flags_only: bool = False
    images_out: str = "all"
    categories_out: str = "all"


_KEPT = dict(info=False, licenses=False, image_fields=False, supercategory=False, confidence=False, attributes=None)
_ROWS = dict(unannotated=True, images_out="annotated", categories_out="referenced")
# Attribute keys that formats hold.
_KITTI = tuple(f"kitti_{k}" for k in ("truncated", "occluded", "alpha", "dim_height", "dim_width", "dim_length", "loc_x", "loc_y", "loc_z", "rotation_y"))
_UNITY = tuple(f"unity_perception_{k}" for k in ("capture_id", "sequence_id", "sequence", "step", "frame", "timestamp", "sensor_id"))
_TFRECORD = ("tfrecord_class_label", "area", "iscrowd", "difficult", "tfrecord_group_of", "tfrecord_weight")

TARGETS = {
    "ir-json": Target(**_KEPT),
    "coco": Target(**{**_KEPT, "attributes": ("area", "iscrowd")}),
    "ibm-cloud-annotations": Target(confidence=False, attributes=None),
    "cvat": Target(attributes=("occluded", "z_order", "source", "cvat_attr_*"), image_attributes=(), unused=True, categories_out="referenced"),
    "label-studio": Target(confidence=False, attributes=("ls_rotation_deg",)),
    "labelbox": Target(image_attributes=("labelbox_data_row_id", "labelbox_row_data", "labelbox_global_key")),
    "scale-ai": Target(image_attributes=("scale_ai_task_id", "scale_ai_attachment")),
    "unity-perception": Target(image_attributes=_UNITY),
    "tfod": Target(**_ROWS),
    "tfrecord": Target(attributes=_TFRECORD, image_attributes=("tfrecord_source_id", "tfrecord_key_sha256", "tfrecord_format", "tfrecord_had_encoded_image"), sparse=_TFRECORD[1:], unused=True, categories_out="referenced"),
    "vott-csv": Target(**_ROWS),
    "vott-json": Target(),
    "yolo": Target(confidence=False),
    "yolo-keras": Target(),
    "yolov4-pytorch": Target(),
    "voc": Target(attributes=("pose", "truncated", "difficult", "occluded"), image_attributes=("depth",)),
    "hf": Target(image_attributes=()),
    "sagemaker": Target(
        info_keys=("sagemaker_label_attribute_name", "sagemaker_creation_date"), confidence=False,
        image_attributes=("sagemaker_source_ref", "sagemaker_image_depth", "sagemaker_creation_date", "sagemaker_job_name"),
    ),
    "labelme": Target(attributes=("labelme_shape_type",), flags_only=True, categories_out="referenced"),
    "superannotate": Target(confidence=False, image_attributes=()),
    "supervisely": Target(image_attributes=()),
    "cityscapes": Target(image_attributes=()),
    "marmot": Target(image_attributes=()),
    "create-ml": Target(flags_only=True, categories_out="referenced"),
    "kitti": Target(confidence=False, attributes=_KITTI),
    "via": Target(attributes=("via_region_attr_*",), image_attributes=("via_size_bytes", "via_file_attr_*")),
    "retinanet": Target(),
    "openimages": Target(confidence=False, attributes=("openimages_*",), **_ROWS),
    "kaggle-wheat": Target(collapse=True, unannotated=True, images_out="annotated", categories_out="one"),
    "automl-vision": Target(**_ROWS),
    "udacity": Target(**_ROWS),
    "datumaro": Target(confidence=False, image_attributes=()),
    "wider-face": Target(image_attributes=(), collapse=True, categories_out="one"),
    "oidv4": Target(image_attributes=()),
    "bdd100k": Target(confidence=False, image_attributes=()),
    "v7-darwin": Target(image_attributes=()),
    "edge-impulse": Target(image_attributes=()),
    "openlabel": Target(confidence=False, image_attributes=()),
    "via-csv": Target(image_attributes=()),
}
#: Codes that some targets use in place of the common ones.
RENAMED = {
    "coco": {"drop_annotation_attributes": "coco_attributes_may_not_be_preserved"},
    "cvat": {"drop_unused_categories": "cvat_writer_drop_unused_categories"},
    "hf": {
        "drop_dataset_info": "hf_metadata_lost", "drop_licenses": "hf_metadata_lost", "drop_category_supercategory": "hf_metadata_lost",
        "drop_image_metadata": "hf_attributes_lost", "drop_annotation_attributes": "hf_attributes_lost", "drop_annotation_confidence": "hf_confidence_lost",
    },
}


def _beyond(keys: tuple[str, ...]) -> Column:
    """Whether a row's attributes have a key that isn't kept."""

    def kept(k: Column) -> Column:
        out = k.isin([x for x in keys if not x.endswith("*")]) if keys else F.lit(False)
        for x in keys:
            if x.endswith("*"):
                out = out | k.startswith(x[:-1])
        return out

    return F.coalesce(F.exists(F.map_keys("attributes"), lambda k: ~kept(k)), F.lit(False))


def lossiness(ds: AnnotationDataset, target: str) -> DataFrame:
    """Rows (code, count) of what the target would lose; none means that nothing is lost.

    Counts are rows concerned, or 1 where a target only tells that there are some.
    """
    t = TARGETS[target]
    facts = _facts(ds, t)
    extra = set(ds.info.get("attributes", {})) - set(t.info_keys)
    has_info = any(ds.info.get(f) is not None for f in INFO) or bool(extra)
    rules: list[tuple[str, Column]] = []
    if t.info and has_info:
        rules.append(("drop_dataset_info", F.lit(1)))
    if target == "coco" and ds.info.get("name") is not None:
        rules.append(("drop_dataset_info_name", F.lit(1)))
    for code, use in (
        ("drop_licenses", t.licenses), ("drop_image_metadata", t.image_fields or t.image_attributes is not None), ("drop_category_supercategory", t.supercategory),
        ("drop_annotation_confidence", t.confidence), ("drop_annotation_attributes", t.attributes is not None), ("drop_images_without_annotations", t.unannotated),
        ("drop_unused_categories", t.unused), ("collapse_multiple_categories_to_single_class", t.collapse), ("drop_sparse_attributes", bool(t.sparse)),
    ):
        if use:
            rules.append((code, F.col(code)))
    names = RENAMED.get(target, {})
    value = lambda c: F.least(c, F.lit(1)) if t.flags_only else c
    found = F.array(*[F.struct(F.lit(names.get(code, code)).alias("code"), value(n.cast("long")).alias("count")) for code, n in rules]) if rules else F.lit(None).cast("array<struct<code:string,count:bigint>>")
    return facts.select(F.inline(found)).where("count > 0").groupBy("code").agg(F.sum("count").alias("count"))


def _facts(ds: AnnotationDataset, t: Target) -> DataFrame:
    """One row with every counter that the target may need."""
    n = F.count_if
    used = ds.annotations.agg(
        n(F.col("confidence").isNotNull()).alias("drop_annotation_confidence"), n(_beyond(t.attributes or ())).alias("drop_annotation_attributes"),
    )
    image_bad = (F.col("license_id").isNotNull() | F.col("date_captured").isNotNull()) if t.image_fields else F.lit(False)
    if t.image_attributes is not None:
        image_bad = image_bad | _beyond(t.image_attributes)
    refs = ds.annotations.select(F.col("image_id").alias("_iid")).distinct()
    bare = ds.images.join(refs, F.col("id") == F.col("_iid"), "left_anti").agg(F.count("*").alias("drop_images_without_annotations"))
    cats = ds.annotations.select(F.col("category_id").alias("_cid")).distinct()
    unused = ds.categories.join(cats, F.col("id") == F.col("_cid"), "left_anti").agg(F.count("*").alias("drop_unused_categories"))
    facts = used.join(ds.images.agg(n(image_bad).alias("drop_image_metadata"))).join(bare).join(unused)
    facts = facts.join(ds.categories.agg(n(F.col("supercategory").isNotNull()).alias("drop_category_supercategory"), F.when(F.count("*") > 1, F.count("*")).otherwise(0).alias("collapse_multiple_categories_to_single_class")))
    facts = facts.join(ds.licenses.agg(F.count("*").alias("drop_licenses")))
    if t.sparse:
        # an attribute is written for an image only if all of the image's annotations have it
        has = lambda k: F.coalesce(F.map_contains_key("attributes", k), F.lit(False))
        by_image = ds.annotations.groupBy("image_id").agg(*[n(has(k)).alias(f"_h{i}") for i, k in enumerate(t.sparse)], F.count("*").alias("_n"))
        some = [(F.col(f"_h{i}") > 0) & (F.col(f"_h{i}") < F.col("_n")) for i in range(len(t.sparse))]
        facts = facts.join(by_image.agg(n(reduce(lambda x, y: x | y, some)).alias("drop_sparse_attributes")))
    else:
        facts = facts.withColumn("drop_sparse_attributes", F.lit(0))
    return facts


def output_counts(ds: AnnotationDataset, target: str) -> DataFrame:
    """Rows (images, categories, annotations) of the converted dataset."""
    t = TARGETS[target]
    a = ds.annotations.agg(F.count("*").alias("annotations"), F.countDistinct("image_id").alias("_i"), F.countDistinct("category_id").alias("_c"))
    one = ds.images.agg(F.count("*").alias("_images")).join(ds.categories.agg(F.count("*").alias("_categories"))).join(a)
    if t.categories_out == "referenced" and (t.unused or t.flags_only):
        used = ds.categories.join(ds.annotations.select(F.col("category_id").alias("_cid")).distinct(), F.col("id") == F.col("_cid"), "left_semi")
        one = one.drop("_c").join(used.agg(F.count("*").alias("_c")))
    images = {"all": F.col("_images"), "annotated": F.col("_i")}[t.images_out]
    categories = {"all": F.col("_categories"), "referenced": F.col("_c"), "one": F.when(F.col("annotations") > 0, F.lit(1)).otherwise(0)}[t.categories_out]
    return one.select(images.alias("images"), categories.cast("long").alias("categories"), "annotations")


def is_lossy(ds: AnnotationDataset, target: str) -> bool:
    return bool(lossiness(ds, target).limit(1).count())
