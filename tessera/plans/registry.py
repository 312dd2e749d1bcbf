"""Queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import diff, lossiness, sample, stats, validate
from tessera.plans import malformed, roundtrips
from tessera.plans.tables import WITH, WITH_CHANGED, derived
from tessera.sources.common import from_raw

Query = Callable[[SparkSession, str], DataFrame]

_FINITE_AREA = "(xmin <= xmax AND ymin <= ymax AND (xmax - xmin) * (ymax - ymin) > 0)"
_LABELLED = "labelled AS (SELECT a.*, coalesce(c.name, concat('<missing cat ', category_id, '>')) AS label FROM annotations a LEFT JOIN categories c ON category_id = c.id)"
_OUT = "(xmin < -0.5 OR ymin < -0.5 OR xmax > width + 0.5 OR ymax > height + 0.5)"


def _on(fn: Callable[..., DataFrame], *args, **kw) -> Query:
    return lambda spark, sf_dir: fn(derived(spark, sf_dir), *args, **kw)


def _both(fn: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: fn(derived(spark, sf_dir), derived(spark, sf_dir, changed=True), *args)


def _density(ds):
    return stats.density(ds).withColumn("mean_per_image", F.round("mean_per_image", 6))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


STATS: dict[str, tuple[Query, str]] = {
    "stats_summary": (_on(stats.summary), f"""{WITH} SELECT (SELECT count(*) FROM images) AS images, (SELECT count(*) FROM categories) AS categories,
        count(*) AS annotations, 0 AS licenses, count(DISTINCT image_id) AS annotated_images FROM annotations"""),
    "stats_labels_top": (_on(stats.labels), f"""{WITH}, {_LABELLED}, n AS (SELECT label, count(*) AS c FROM labelled GROUP BY label),
        t AS (SELECT * FROM n ORDER BY c DESC, label LIMIT 10)
        SELECT label, c AS "count", (SELECT count(*) FROM n) AS total_distinct, (SELECT CAST(sum(c) AS BIGINT) FROM n) AS total_annotations,
        (SELECT CAST(sum(c) AS BIGINT) FROM n) - (SELECT CAST(sum(c) AS BIGINT) FROM t) AS other_count FROM t"""),
    "stats_bbox": (_on(stats.boxes), f"""{WITH}, s AS (SELECT a.*, i.id AS iid, width, height, xmin <= xmax AND ymin <= ymax AS ok FROM annotations a LEFT JOIN images i ON image_id = i.id)
        SELECT count(*) AS total, count(*) AS finite, count(*) FILTER (ok) AS ordered, count(*) FILTER (iid IS NOT NULL) AS oob_checked,
        count(*) FILTER (iid IS NOT NULL AND {_OUT}) AS out_of_bounds, count(*) FILTER (ok AND (xmax - xmin) * (ymax - ymin) <= 0) AS degenerate_area,
        count(*) FILTER (iid IS NULL) AS missing_image_ref, min(xmax - xmin) FILTER (ok) AS min_width, max(xmax - xmin) FILTER (ok) AS max_width,
        min(ymax - ymin) FILTER (ok) AS min_height, max(ymax - ymin) FILTER (ok) AS max_height FROM s"""),
    "stats_resolution": (_on(lambda ds: _rounded(stats.resolutions(ds), "mean_w", "mean_h")), f"""{WITH} SELECT min(width) AS min_w, max(width) AS max_w, min(height) AS min_h, max(height) AS max_h,
        round(avg(width), 6) AS mean_w, round(avg(height), 6) AS mean_h FROM images"""),
    "stats_density": (_on(_density), f"""{WITH}, n AS (SELECT image_id, count(*) AS c FROM annotations GROUP BY 1), d AS (SELECT coalesce(c, 0) AS c FROM images LEFT JOIN n ON id = image_id)
        SELECT min(c) AS min_per_image, max(c) AS max_per_image, round(avg(c), 6) AS mean_per_image, count(*) FILTER (c = 0) AS zero_annotation_images FROM d"""),
    "stats_area": (_on(stats.areas), f"""{WITH}, s AS (SELECT {_FINITE_AREA} AS ok, (xmax - xmin) * (ymax - ymin) AS a FROM annotations)
        SELECT count(*) FILTER (ok AND a < 1024) AS small, count(*) FILTER (ok AND a >= 1024 AND a < 9216) AS medium, count(*) FILTER (ok AND a >= 9216) AS large, count(*) FILTER (NOT ok) AS invalid FROM s"""),
    "stats_aspect": (_on(stats.aspects), f"""{WITH}, s AS (SELECT {_FINITE_AREA} AS ok, CASE WHEN {_FINITE_AREA} THEN (xmax - xmin) / (ymax - ymin) END AS r FROM annotations),
        b(name, lo, hi) AS (VALUES ('<0.5', -1.0, 0.5), ('0.5-1', 0.5, 1.0), ('1-2', 1.0, 2.0), ('2-5', 2.0, 5.0), ('>=5', 5.0, 1e300))
        SELECT name, count(r) AS "count", (SELECT count(*) FILTER (NOT ok) FROM s) AS invalid FROM b LEFT JOIN s ON r >= lo AND r < hi GROUP BY name"""),
    "stats_per_category": (_on(lambda ds: _rounded(stats.by_category(ds), "mean_area")), f"""{WITH}, {_LABELLED}
        SELECT label AS category, count(*) AS annotations, min((xmax - xmin) * (ymax - ymin)) FILTER ({_FINITE_AREA}) AS min_area, max((xmax - xmin) * (ymax - ymin)) FILTER ({_FINITE_AREA}) AS max_area,
        round(avg((xmax - xmin) * (ymax - ymin)) FILTER ({_FINITE_AREA}), 6) AS mean_area FROM labelled GROUP BY label ORDER BY annotations DESC, category LIMIT 10"""),
    "stats_cooccurrence": (_on(stats.cooccurrence), f"""{WITH}, {_LABELLED}, o AS (SELECT DISTINCT image_id, label FROM labelled)
        SELECT x.label AS a, y.label AS b, count(*) AS "count" FROM o x JOIN o y ON x.image_id = y.image_id AND x.label < y.label GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""),
}

_ISSUES = f"""{WITH}, ai AS (
  SELECT a.*, i.id AS iid, width, height, c.id AS cid, row_number() OVER (PARTITION BY a.id ORDER BY ord) AS rn
  FROM annotations a LEFT JOIN images i ON image_id = i.id LEFT JOIN categories c ON category_id = c.id),
issues AS (
  SELECT 'error' AS severity, 'InvalidImageDimensions' AS code, 'image' AS context, id FROM images WHERE width = 0 OR height = 0
  UNION ALL SELECT 'warning', 'DuplicateCategoryName', 'category', id FROM (SELECT id, row_number() OVER (PARTITION BY name ORDER BY id) AS rn FROM categories) WHERE rn > 1
  UNION ALL SELECT 'error', 'DuplicateAnnotationId', 'annotation', id FROM ai WHERE rn > 1
  UNION ALL SELECT 'error', 'MissingImageRef', 'annotation', id FROM ai WHERE iid IS NULL
  UNION ALL SELECT 'error', 'MissingCategoryRef', 'annotation', id FROM ai WHERE cid IS NULL
  UNION ALL SELECT 'error', 'InvalidBBoxOrdering', 'annotation', id FROM ai WHERE xmin > xmax OR ymin > ymax
  UNION ALL SELECT 'warning', 'InvalidBBoxArea', 'annotation', id FROM ai WHERE (xmax - xmin) * (ymax - ymin) <= 0
  UNION ALL SELECT 'error', 'BBoxOutOfBounds', 'annotation', id FROM ai WHERE iid IS NOT NULL AND {_OUT})"""


def _coded(*codes: str) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = validate.validate(derived(spark, sf_dir)).drop("message")
        return rows.where(F.col("code").isin(list(codes))) if codes else rows

    where = f" WHERE code IN ({', '.join(repr(c) for c in codes)})" if codes else ""
    return run, f"{_ISSUES} SELECT severity, code, context, id FROM issues{where}"


def _faulty(ds):
    """The derived dataset with repeated ids, empty names and a coordinate that is no number."""
    i = ds.images.union(ds.images.where("id % 307 = 0").withColumns({"file_name": F.lit(""), "_ord": F.col("_ord") + 0.5}).select(*ds.images.columns))
    c = ds.categories.union(ds.categories.where("id % 23 = 0").withColumns({"name": F.lit(""), "_ord": F.col("_ord") + 0.5}).select(*ds.categories.columns))
    return ds.changed(images=i, categories=c, annotations=ds.annotations.withColumn("xmin", F.when(F.col("id") % 113 == 0, float("nan")).otherwise(F.col("xmin"))))


VALIDATE: dict[str, tuple[Query, str]] = {
    "validate_duplicate_ids": _coded("DuplicateImageId", "DuplicateCategoryId", "DuplicateAnnotationId"),
    "validate_refs": _coded("MissingImageRef", "MissingCategoryRef"),
    "validate_dims": _coded("InvalidImageDimensions", "EmptyFileName"),
    "validate_dup_category_name": _coded("DuplicateCategoryName", "EmptyCategoryName"),
    "validate_bbox_rules": _coded("BBoxNotFinite", "InvalidBBoxOrdering", "InvalidBBoxArea", "BBoxOutOfBounds"),
    "validate_all_issues": _coded(),
    "validate_faulty": (lambda s, d: validate.validate(_faulty(derived(s, d))).where(F.col("code").isin("DuplicateImageId", "EmptyFileName", "DuplicateCategoryId", "EmptyCategoryName", "BBoxNotFinite")).drop("message"), f"""{WITH},
        i AS (SELECT id FROM images WHERE id % 307 = 0), c AS (SELECT id FROM categories WHERE id % 23 = 0)
        SELECT 'error' AS severity, 'DuplicateImageId' AS code, 'image' AS context, id FROM i UNION ALL SELECT 'warning', 'EmptyFileName', 'image', id FROM i
        UNION ALL SELECT 'error', 'DuplicateCategoryId', 'category', id FROM c UNION ALL SELECT 'warning', 'EmptyCategoryName', 'category', id FROM c
        UNION ALL SELECT 'error', 'BBoxNotFinite', 'annotation', id FROM annotations WHERE id % 113 = 0"""),
    "validate_counts": (lambda s, d: validate.counts(validate.validate(derived(s, d))), f"{_ISSUES} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues"),
}

_BY_ID = f"""{WITH_CHANGED}, na AS (SELECT file_name, a.id, coalesce(c.name, concat('<missing cat ', category_id, '>')) AS category, xmin, ymin, xmax, ymax
  FROM annotations a JOIN images i ON image_id = i.id LEFT JOIN categories c ON category_id = c.id QUALIFY row_number() OVER (PARTITION BY file_name, a.id ORDER BY ord DESC) = 1),
nb AS (SELECT file_name, a.id, coalesce(c.name, concat('<missing cat ', category_id, '>')) AS category, xmin, ymin, xmax, ymax
  FROM annotations_b a JOIN images_b i ON image_id = i.id LEFT JOIN categories c ON category_id = c.id QUALIFY row_number() OVER (PARTITION BY file_name, a.id ORDER BY ord DESC) = 1),
d AS (SELECT file_name, id, CASE WHEN a.category IS NULL THEN 'only_in_b' WHEN b.category IS NULL THEN 'only_in_a' ELSE 'shared' END AS side,
  CASE WHEN a.category IS NOT NULL AND b.category IS NOT NULL THEN nullif(concat_ws(', ', CASE WHEN a.category <> b.category THEN 'category changed' END,
    CASE WHEN NOT (abs(a.xmin - b.xmin) <= 1e-6 AND abs(a.ymin - b.ymin) <= 1e-6 AND abs(a.xmax - b.xmax) <= 1e-6 AND abs(a.ymax - b.ymax) <= 1e-6) THEN 'bbox changed' END), '') END AS change
  FROM na a FULL JOIN nb b USING (file_name, id))"""
# Greedy matching as recursion over a's boxes: ``p`` holds the pairs that overlap enough, ``s`` the places of b taken so far.
_BY_OVERLAP = f"""{WITH_CHANGED.replace("WITH ", "WITH RECURSIVE ", 1)}, na AS (SELECT file_name, coalesce(c.name, concat('<missing cat ', category_id, '>')) AS category, xmin, ymin, xmax, ymax,
  row_number() OVER (PARTITION BY file_name, category ORDER BY ord) AS k FROM annotations a JOIN images i ON image_id = i.id LEFT JOIN categories c ON category_id = c.id),
nb AS (SELECT file_name, coalesce(c.name, concat('<missing cat ', category_id, '>')) AS category, xmin, ymin, xmax, ymax,
  row_number() OVER (PARTITION BY file_name, category ORDER BY ord) AS k FROM annotations_b a JOIN images_b i ON image_id = i.id LEFT JOIN categories c ON category_id = c.id),
o AS (SELECT a.file_name, a.category, a.k AS i, b.k AS j, (a.xmax - a.xmin) * (a.ymax - a.ymin) AS x, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS y,
  greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS lap
  FROM na a JOIN nb b USING (file_name, category) WHERE a.xmin <= a.xmax AND a.ymin <= a.ymax AND b.xmin <= b.xmax AND b.ymin <= b.ymax),
p AS (SELECT file_name, category, i, j, lap / (x + y - lap) AS iou FROM o WHERE x + y - lap > 0 AND lap / (x + y - lap) >= 0.5),
ta AS (SELECT file_name, category, count(*) AS n FROM na GROUP BY ALL), tb AS (SELECT file_name, category, count(*) AS n FROM nb GROUP BY ALL),
s AS (SELECT file_name, category, 0 AS i, CAST([] AS BIGINT[]) AS taken FROM ta JOIN tb USING (file_name, category)
  UNION ALL SELECT s.file_name, s.category, s.i + 1, list_concat(any_value(s.taken), coalesce(list_slice(list(p.j ORDER BY p.iou DESC, p.j) FILTER (p.j IS NOT NULL AND NOT list_contains(s.taken, p.j)), 1, 1), []))
  FROM s JOIN ta ON ta.file_name = s.file_name AND ta.category = s.category AND s.i < ta.n LEFT JOIN p ON p.file_name = s.file_name AND p.category = s.category AND p.i = s.i + 1
  GROUP BY s.file_name, s.category, s.i),
m AS (SELECT file_name, category, max(len(taken)) AS shared FROM s GROUP BY ALL)"""
_SIDE = "CASE WHEN a.{0} IS NULL THEN 'only_in_b' WHEN b.{0} IS NULL THEN 'only_in_a' ELSE 'shared' END AS side"
DIFF: dict[str, tuple[Query, str]] = {
    "diff_images": (_both(diff.image_names), f"{WITH_CHANGED} SELECT coalesce(a.file_name, b.file_name) AS file_name, {_SIDE.format('file_name')} FROM (SELECT DISTINCT file_name FROM images) a FULL JOIN (SELECT DISTINCT file_name FROM images_b) b ON a.file_name = b.file_name"),
    "diff_categories": (_both(diff.category_names), f"{WITH} SELECT DISTINCT name, 'shared' AS side FROM categories"),
    "diff_annotations_id": (lambda s, d: diff.totals(_both(diff.by_id)(s, d)), f"""{_BY_ID} SELECT count(*) FILTER (side = 'shared') AS shared, count(*) FILTER (side = 'only_in_a') AS only_in_a,
        count(*) FILTER (side = 'only_in_b') AS only_in_b, count(change) AS modified FROM d"""),
    "diff_modified_detail": (lambda s, d: _both(diff.by_id)(s, d).where("change is not null"), f"{_BY_ID} SELECT * FROM d WHERE change IS NOT NULL"),
    "diff_iou": (_both(diff.by_overlap), f"""{_BY_OVERLAP} SELECT file_name, category, coalesce(shared, 0) AS shared, coalesce(ta.n, 0) - coalesce(shared, 0) AS only_in_a, coalesce(tb.n, 0) - coalesce(shared, 0) AS only_in_b
        FROM ta FULL JOIN tb USING (file_name, category) LEFT JOIN m USING (file_name, category)"""),
}

_WANTED = ["cls_003", " cls_017 ", "cls_040"]
_IN = "(SELECT id FROM categories WHERE name IN ('cls_003', 'cls_017', 'cls_040'))"


def _parts(ds) -> DataFrame:
    """A dataset's ids as rows (part, id)."""
    return ds.images.select(F.lit("image").alias("part"), "id").union(ds.annotations.select(F.lit("annotation").alias("part"), "id"))


def _subset(ds) -> DataFrame:
    return _parts(sample.subset(ds, ds.images.where("width > 1000").select("id")))


_MD5 = "md5(concat('7:', file_name))"
_WEIGHTS = """, f AS (SELECT category_id, count(*) AS n FROM annotations GROUP BY 1),
s AS (SELECT image_id, sum(1.0 / n) AS w FROM (SELECT DISTINCT image_id, category_id FROM annotations) JOIN f USING (category_id) GROUP BY 1),
weights AS (SELECT id, file_name, coalesce(w, 0) AS weight FROM images LEFT JOIN s ON id = image_id)"""
_U = f"((CAST('0x' || substr({_MD5}, 1, 13) AS BIGINT) + 1) / 4503599627370497.0)"
SAMPLE: dict[str, tuple[Query, str]] = {
    "filter_categories_images": (_on(lambda ds: _parts(sample.filter_categories(ds, _WANTED))), f"""{WITH}, k AS (SELECT DISTINCT image_id FROM annotations WHERE category_id IN {_IN} AND image_id IN (SELECT id FROM images))
        SELECT 'image' AS part, image_id AS id FROM k UNION ALL SELECT 'annotation', id FROM annotations WHERE image_id IN (SELECT image_id FROM k)"""),
    "filter_categories_annotations": (_on(lambda ds: _parts(sample.filter_categories(ds, _WANTED, "annotations"))), f"""{WITH}, k AS (SELECT * FROM annotations WHERE category_id IN {_IN} AND image_id IN (SELECT id FROM images))
        SELECT DISTINCT 'image' AS part, image_id AS id FROM k UNION ALL SELECT 'annotation', id FROM k"""),
    "subset_ids": (_on(_subset), f"""{WITH}, k AS (SELECT id FROM images WHERE width > 1000) SELECT 'image' AS part, id FROM k UNION ALL SELECT 'annotation', id FROM annotations WHERE image_id IN (SELECT id FROM k)"""),
    "image_weights": (_on(lambda ds: _rounded(sample.weights(ds), "weight")), f"{WITH}{_WEIGHTS} SELECT id, file_name, round(weight, 6) AS weight FROM weights"),
    "sample_target": (_on(lambda ds: ds.images.agg(F.count("*").alias("total")).select("total", F.least(F.greatest(F.lit(1), F.ceil(F.col("total") * 0.1)), "total").alias("target"))),
        f"{WITH} SELECT count(*) AS total, least(greatest(1, CAST(ceil(count(*) * 0.1) AS BIGINT)), count(*)) AS target FROM images"),
    "sample_random": (_on(sample.random, 500, 7), f"{WITH} SELECT id FROM images ORDER BY {_MD5}, file_name, id LIMIT 500"),
    "sample_stratified": (_on(sample.stratified, 500, 7), f"""{WITH}{_WEIGHTS} SELECT id FROM weights
        ORDER BY (weight > 0) DESC, CASE WHEN weight > 0 THEN round(-ln({_U}) / weight, 9) ELSE {_U} END, id LIMIT 500"""),
}

_COUNTS = {
    "dated": "(SELECT count(*) FROM images WHERE date_captured IS NOT NULL)",
    "super": "(SELECT count(supercategory) FROM categories)",
    "confidence": "(SELECT count(confidence) FROM annotations)",
    "attributes": "(SELECT count(attribute) FROM annotations)",
    "but_occluded": "(SELECT count(*) FROM annotations WHERE attribute <> 'occluded')",
    "but_iscrowd": "(SELECT count(*) FROM annotations WHERE attribute <> 'iscrowd')",
    "bare": "(SELECT count(*) FROM images WHERE id NOT IN (SELECT image_id FROM annotations))",
    "unused": "(SELECT count(*) FROM categories WHERE id NOT IN (SELECT category_id FROM annotations))",
    "classes": "(SELECT count(*) FROM categories)",
    "sparse": "(SELECT count(*) FROM (SELECT image_id FROM annotations GROUP BY image_id HAVING count(*) FILTER (coalesce(attribute, '') = 'iscrowd') BETWEEN 1 AND count(*) - 1))",
}
_I, _S, _C, _A = "drop_image_metadata=dated", "drop_category_supercategory=super", "drop_annotation_confidence=confidence", "drop_annotation_attributes=attributes"
_PLAIN, _BARE, _ONE = f"{_I} {_S} {_C} {_A}", "drop_images_without_annotations=bare", "collapse_multiple_categories_to_single_class=classes"
# What each target drops of the derived tables, written down apart from the rules under test. A ! after a
# count: the target only tells that there are some.
_DROPS = {
    "ir-json": "",
    "coco": "coco_attributes_may_not_be_preserved=but_iscrowd",
    "ibm-cloud-annotations": f"{_I} {_S}",
    "cvat": f"{_I} {_S} {_C} drop_annotation_attributes=but_occluded cvat_writer_drop_unused_categories=unused",
    "label-studio": f"{_I} {_S} {_A}",
    "labelbox": _PLAIN,
    "scale-ai": _PLAIN,
    "unity-perception": _PLAIN,
    "tfod": f"{_PLAIN} {_BARE}",
    "tfrecord": f"{_I} {_S} {_C} drop_annotation_attributes=but_iscrowd drop_sparse_attributes=sparse drop_unused_categories=unused",
    "vott-csv": f"{_PLAIN} {_BARE}",
    "vott-json": _PLAIN,
    "yolo": f"{_I} {_S} {_A}",
    "yolo-keras": _PLAIN,
    "yolov4-pytorch": _PLAIN,
    "voc": f"{_I} {_S} {_C} drop_annotation_attributes=but_occluded",
    "hf": "hf_attributes_lost=dated hf_metadata_lost=super hf_confidence_lost=confidence hf_attributes_lost=attributes",
    "sagemaker": f"{_I} {_S} {_A}",
    "labelme": "drop_image_metadata=dated! drop_category_supercategory=super! drop_annotation_confidence=confidence! drop_annotation_attributes=attributes!",
    "superannotate": f"{_I} {_S} {_A}",
    "supervisely": _PLAIN,
    "cityscapes": _PLAIN,
    "marmot": _PLAIN,
    "create-ml": "drop_image_metadata=dated! drop_category_supercategory=super! drop_annotation_confidence=confidence! drop_annotation_attributes=attributes!",
    "kitti": f"{_I} {_S} {_A}",
    "via": _PLAIN,
    "retinanet": _PLAIN,
    "openimages": f"{_I} {_S} {_A} {_BARE}",
    "kaggle-wheat": f"{_PLAIN} {_ONE} {_BARE}",
    "automl-vision": f"{_PLAIN} {_BARE}",
    "udacity": f"{_PLAIN} {_BARE}",
    "datumaro": f"{_I} {_S} {_A}",
    "wider-face": f"{_PLAIN} {_ONE}",
    "oidv4": _PLAIN,
    "bdd100k": f"{_I} {_S} {_A}",
    "v7-darwin": _PLAIN,
    "edge-impulse": _PLAIN,
    "openlabel": f"{_I} {_S} {_A}",
    "via-csv": _PLAIN,
}


def _loss_sql(name: str) -> str:
    rows = []
    for drop in _DROPS[name].split():
        code, count = drop.split("=")
        n = _COUNTS[count.rstrip("!")]
        rows.append(f"SELECT '{code}' AS code, {f'least({n}, 1)' if count.endswith('!') else n} AS n")
    body = " UNION ALL ".join(rows) or "SELECT '' AS code, 0 AS n"
    return f"""{WITH} SELECT code, CAST(sum(n) AS BIGINT) AS "count" FROM ({body}) WHERE n > 0 GROUP BY code"""


LOSSINESS = {f"lossiness_{t.replace('-', '_')}": (_on(lossiness.lossiness, t), _loss_sql(t)) for t in lossiness.TARGETS}


def _geometry(fn: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = derived(spark, sf_dir)
        dims = ds.images.select(F.col("id").alias("iid"), "width", "height")
        rows = ds.annotations.join(dims, F.col("image_id") == F.col("iid"))
        return fn(rows, g.box(), F.col("width").cast("double"), F.col("height").cast("double"))

    return run


def _named(prefix: str, cols) -> list:
    return [F.round(c, 6).alias(f"{prefix}{i}") for i, c in enumerate(cols)]


_SIZED = f"{WITH}, s AS (SELECT a.*, width, height FROM annotations a JOIN images i ON image_id = i.id)"
GEOMETRY: dict[str, tuple[Query, str]] = {
    "geom_xywh": (_geometry(lambda df, b, w, h: df.select("id", *_named("b", [*g.to_xywh(b), *g.from_xywh(*g.to_xywh(b))]))), f"""{_SIZED} SELECT id, round(xmin, 6) AS b0, round(ymin, 6) AS b1, round(xmax - xmin, 6) AS b2, round(ymax - ymin, 6) AS b3,
        round(xmin, 6) AS b4, round(ymin, 6) AS b5, round(xmax, 6) AS b6, round(ymax, 6) AS b7 FROM s"""),
    "geom_cxcywh": (_geometry(lambda df, b, w, h: df.select("id", *_named("b", [*g.to_cxcywh(b), *g.from_cxcywh(*g.to_cxcywh(b))]))), f"""{_SIZED} SELECT id, round((xmin + xmax) / 2, 6) AS b0, round((ymin + ymax) / 2, 6) AS b1, round(xmax - xmin, 6) AS b2, round(ymax - ymin, 6) AS b3,
        round(xmin, 6) AS b4, round(ymin, 6) AS b5, round(xmax, 6) AS b6, round(ymax, 6) AS b7 FROM s"""),
    "geom_normalized": (_geometry(lambda df, b, w, h: df.where("width > 0").select("id", *[F.round(c, 9).alias(f"b{i}") for i, c in enumerate(g.to_normalized(b, w, h))])), f"{_SIZED} SELECT id, round(xmin / width, 9) AS b0, round(ymin / height, 9) AS b1, round(xmax / width, 9) AS b2, round(ymax / height, 9) AS b3 FROM s WHERE width > 0"),
    "geom_percent": (_geometry(lambda df, b, w, h: df.where("width > 0").select("id", *_named("b", g.to_percent(b, w, h)))), f"{_SIZED} SELECT id, round(xmin / width * 100, 6) AS b0, round(ymin / height * 100, 6) AS b1, round((xmax / width - xmin / width) * 100, 6) AS b2, round((ymax / height - ymin / height) * 100, 6) AS b3 FROM s WHERE width > 0"),
    "geom_iou": (_geometry(lambda df, b, w, h: df.select("id", F.round(g.iou(b, g.Box(b.xmin + 5, b.ymin + 3, b.xmax + 5, b.ymax + 3)), 6).alias("iou"))), f"""{_SIZED}, o AS (SELECT id, xmin <= xmax AND ymin <= ymax AS ok, (xmax - xmin) * (ymax - ymin) AS a,
        greatest(0, xmax - xmin - 5) * greatest(0, ymax - ymin - 3) AS i FROM s) SELECT id, CASE WHEN ok AND 2 * a - i > 0 THEN round(i / (2 * a - i), 6) ELSE 0.0 END AS iou FROM o"""),
    "geom_rotated_envelope": (_geometry(lambda df, b, w, h: df.select("id", *[F.round(c, 4).alias(f"b{i}") for i, c in enumerate(g.rotated_envelope(b.xmin, b.ymin, b.xmax - b.xmin, b.ymax - b.ymin, F.lit(30.0)))])),
        f"""{_SIZED}, r AS (SELECT id, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h, cos(radians(30)) AS c, sin(radians(30)) AS s FROM s)
        SELECT id, round(least(x, x + w * c, x - h * s, x + w * c - h * s), 4) AS b0, round(least(y, y + w * s, y + h * c, y + w * s + h * c), 4) AS b1,
        round(greatest(x, x + w * c, x - h * s, x + w * c - h * s), 4) AS b2, round(greatest(y, y + w * s, y + h * c, y + w * s + h * c), 4) AS b3 FROM r"""),
}


def _raw(ds) -> DataFrame:
    """What a reader without ids yields: boxes with file names and labels."""
    i, c = ds.images.select(F.col("id").alias("_i"), "file_name"), ds.categories.select(F.col("id").alias("_c"), F.col("name").alias("label"))
    rows = ds.annotations.join(i, F.col("image_id") == F.col("_i")).join(c, F.col("category_id") == F.col("_c"))
    return rows.select("file_name", "label", *g.box()._fields, "_ord")


_JOINED = "annotations JOIN images i ON image_id = i.id JOIN categories c ON category_id = c.id"
IDS: dict[str, tuple[Query, str]] = {
    "id_assignment_lex": (_on(lambda ds: from_raw(None, _raw(ds)).categories.select("id", "name")), f"{WITH}, n AS (SELECT DISTINCT c.name FROM {_JOINED}) SELECT row_number() OVER (ORDER BY name) AS id, name FROM n"),
    "dims_inference": (_on(lambda ds: from_raw(None, _raw(ds)).images.select("file_name", "width", "height")), f"""{WITH} SELECT file_name, CAST(greatest(ceil(max(xmax)), 1) AS BIGINT) AS width, CAST(greatest(ceil(max(ymax)), 1) AS BIGINT) AS height
        FROM {_JOINED} GROUP BY file_name"""),
}


def _all() -> dict[str, tuple[Query, str]]:
    return STATS | VALIDATE | DIFF | SAMPLE | LOSSINESS | GEOMETRY | IDS | malformed.queries() | roundtrips.queries()


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items()}
