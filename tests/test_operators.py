import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.model import dataset, numbered
from tessera.operators import diff, lossiness, sample, stats, validate


def make(spark, images, categories, annotations, **kw):
    i = spark.createDataFrame(images, "id long, file_name string, width long, height long, _ord long")
    c = spark.createDataFrame(categories, "id long, name string, supercategory string, _ord long")
    a = spark.createDataFrame([(*x, {}, n) for n, x in enumerate(annotations)], "id long, image_id long, category_id long, xmin double, ymin double, xmax double, ymax double, confidence double, attributes map<string,string>, _ord long")
    return dataset(i, c, a, **kw)


@pytest.fixture(scope="module")
def odd(spark):
    """Every rule broken once or more."""
    nan, inf = float("nan"), float("inf")
    images = [(1, "a.jpg", 100, 100, 0), (1, "b.jpg", 50, 50, 1), (2, "", 0, 10, 2), (3, "c.jpg", 10, 10, 3)]
    categories = [(1, "cat", None, 0), (2, "", None, 1), (3, "cat", "pet", 2), (1, "dog", None, 3)]
    annotations = [(1, 1, 1, 0.0, 0.0, 10.0, 10.0, None), (1, 9, 9, 0.0, 0.0, 1.0, 1.0, 0.5), (2, 1, 3, nan, 0.0, 1.0, 1.0, None), (3, 1, 3, 5.0, 5.0, 1.0, 1.0, None), (4, 1, 3, 5.0, 5.0, 5.0, 9.0, None), (5, 1, 3, 0.0, 0.0, 50.6, 1.0, None), (6, 1, 3, 0.0, -inf, 1.0, 1.0, None)]
    return make(spark, images, categories, annotations)


def test_validation_rules(odd):
    got = sorted((r.code, r.id) for r in validate.validate(odd).collect())
    assert got == sorted([
        ("DuplicateImageId", 1), ("InvalidImageDimensions", 2), ("EmptyFileName", 2), ("DuplicateCategoryId", 1), ("EmptyCategoryName", 2), ("DuplicateCategoryName", 3),
        ("DuplicateAnnotationId", 1), ("MissingImageRef", 1), ("MissingCategoryRef", 1), ("BBoxNotFinite", 2), ("BBoxNotFinite", 6), ("InvalidBBoxOrdering", 3), ("InvalidBBoxArea", 4), ("BBoxOutOfBounds", 5),
    ])
    assert validate.counts(validate.validate(odd)).first() == (10, 4)
    assert not validate.passes(validate.validate(odd))


def test_profile(odd):
    p = {k: [r.asDict() for r in v.collect()] for k, v in stats.profile(odd).items()}
    assert p["summary"] == [{"images": 4, "categories": 4, "annotations": 7, "licenses": 0, "annotated_images": 2}]
    assert [(r["label"], r["count"]) for r in p["labels"]] == [("cat", 5), ("<missing cat 9>", 1), ("dog", 1)]
    b = p["bboxes"][0]
    assert (b["total"], b["finite"], b["ordered"], b["oob_checked"], b["out_of_bounds"], b["degenerate_area"], b["missing_image_ref"]) == (7, 5, 4, 4, 1, 1, 1)
    assert p["annotation_density"] == [{"min_per_image": 0, "max_per_image": 6, "mean_per_image": 2.0, "zero_annotation_images": 2}]
    assert sum(r["count"] for r in p["aspect_ratios"]) == 3 and p["aspect_ratios"][0]["invalid"] == 4


def test_no_rows(spark):
    e = make(spark, [], [], [])
    assert stats.resolutions(e).first().asDict() == {"min_w": 0, "max_w": 0, "min_h": 0, "max_h": 0, "mean_w": 0.0, "mean_h": 0.0}
    assert len(stats.aspects(e).collect()) == 5 and stats.labels(e).count() == 0 and validate.validate(e).count() == 0
    assert diff.by_overlap(e, e).count() == 0 and diff.totals(diff.by_id(e, e)).first() == (0, 0, 0, 0)


def test_overlap_matching_is_greedy_in_order(spark):
    rng = random.Random(4)

    def boxes(n):
        out = []
        for i in range(n):
            x, y = rng.randrange(8), rng.randrange(8)
            out.append((i, rng.choice([1, 2]), rng.choice([1, 2]), float(x), float(y), float(x + rng.randrange(-1, 7)), float(y + rng.randrange(0, 7)), None))
        return out

    images, cats = [(1, "a", 20, 20, 0), (2, "b", 20, 20, 1)], [(1, "x", None, 0), (2, "y", None, 1)]
    left, right = boxes(60), boxes(50)
    got = {(r.file_name, r.category): (r.shared, r.only_in_a, r.only_in_b) for r in diff.by_overlap(make(spark, images, cats, left), make(spark, images, cats, right), 0.3).collect()}

    def iou(a, b):
        if any(v[3] > v[5] or v[4] > v[6] for v in (a, b)):
            return 0.0
        i = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
        u = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i
        return i / u if u > 0 else 0.0

    for image, f in ((1, "a"), (2, "b")):
        for cat, c in ((1, "x"), (2, "y")):
            a, b = ([r for r in side if r[1] == image and r[2] == cat] for side in (left, right))
            free, hit = list(b), 0
            for r in a:
                best = max(free, key=lambda o: iou(r, o), default=None)
                if best is not None and iou(r, best) >= 0.3:
                    free.remove(best)
                    hit += 1
            assert got[(f, c)] == (hit, len(a) - hit, len(b) - hit)


def test_sampling(spark):
    images = [(i, f"f{i}.jpg", 10, 10, i) for i in range(50)]
    ds = make(spark, images, [(1, "a", None, 0), (2, "b", None, 1)], [(i, i, 1 if i else 2, 0.0, 0.0, 1.0, 1.0, None) for i in range(30)])
    assert sample.target(50, fraction=0.01) == 1 and sample.target(50, n=80) == 50
    for bad in ({}, {"n": 1, "fraction": 0.5}, {"n": 0}, {"fraction": 1.5}):
        with pytest.raises(ValueError):
            sample.target(5, **bad)
    first = sorted(r.id for r in sample.random(ds, 10, 3).collect())
    assert first == sorted(r.id for r in sample.random(ds.changed(images=ds.images.repartition(7)), 10, 3).collect()) and len(first) == 10
    drawn = {r.id for r in sample.stratified(ds, 30, 1).collect()}
    assert drawn == set(range(30))
    hits = sum(0 in {r.id for r in sample.stratified(ds, 5, seed).collect()} for seed in range(12))
    assert hits >= 9  # the only image of its category has most of the weight
    assert sample.sample(ds, n=100) is ds
    cut = sample.sample(ds, n=10, seed=3)
    assert cut.images.count() == 10 and cut.annotations.join(cut.images, F.col("image_id") == cut.images["id"], "left_anti").count() == 0


def test_category_filters(spark):
    ds = make(spark, [(i, f"{i}", 1, 1, i) for i in range(4)], [(1, "a", None, 0), (2, "b", None, 1)], [(1, 0, 1, 0.0, 0.0, 1.0, 1.0, None), (2, 0, 2, 0.0, 0.0, 1.0, 1.0, None), (3, 1, 2, 0.0, 0.0, 1.0, 1.0, None), (4, 9, 1, 0.0, 0.0, 1.0, 1.0, None)])
    whole, part = sample.filter_categories(ds, [" a "]), sample.filter_categories(ds, ["a"], "annotations")
    assert ({r.id for r in whole.images.collect()}, {r.id for r in whole.annotations.collect()}) == ({0}, {1, 2})
    assert ({r.id for r in part.images.collect()}, {r.id for r in part.annotations.collect()}) == ({0}, {1})
    assert sample.filter_categories(ds, ["  "]) is ds
    with pytest.raises(ValueError):
        sample.filter_categories(ds, ["zebra"])


def test_geometry(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0.0, 0.0, 4.0, 2.0), (nan, 0.0, 1.0, 1.0), (0.0, 0.0, inf, 1.0), (3.0, 0.0, 1.0, 1.0)], "xmin double, ymin double, xmax double, ymax double")
    b = g.box()
    assert [tuple(r) for r in df.select(g.finite(b), g.ordered(b), g.valid_area(b), g.iou(b, b)).collect()] == [(True, True, True, 1.0), (False, False, False, 0.0), (False, False, False, 0.0), (True, False, False, 0.0)]
    zero = F.lit(0)
    assert [str(v) for v in df.select(*g.to_normalized(b, zero, zero)).first()] == ["nan", "nan", "inf", "inf"]
    assert not df.select(g.near(b, b)).collect()[1][0]
    turned = df.select(*g.rotated_envelope(b.xmin, b.ymin, b.xmax, b.ymax, F.lit(90.0))).first()
    assert [round(v, 9) for v in turned] == [-2.0, 0.0, 0.0, 4.0]


def test_numbering(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(9)
    got = numbered(df, "v").collect()
    assert all(r._n == r.v + 1 for r in got) and len(got) == 1000


def test_numbering_holds_in_many_branches(spark):
    """Adaptive execution deals each branch of a plan as it likes: numbers must not depend on that."""
    rows = spark.range(150_000).selectExpr("(id * 7919) % 150000 AS v", "id % 97 AS g").repartition(13)
    for _ in range(3):
        got = numbered(rows, "v")
        totals = rows.groupBy("g").count().withColumnRenamed("g", "h")
        joined = got.join(got.select(F.col("_n").alias("_m"), F.col("v").alias("w")), F.col("_n") == F.col("_m")).join(totals, F.col("g") == F.col("h")).cache()
        assert joined.count() == 150_000 and joined.where("_n <> v + 1 or v <> w").count() == 0
        assert got.select("_n").distinct().count() == 150_000
        joined.unpersist()


def test_lossiness(spark, odd):
    ds = odd.changed(annotations=odd.annotations.withColumn("attributes", F.when(F.col("id") == 1, F.create_map(F.lit("area"), F.lit("1"), F.lit("via_region_attr_x"), F.lit("2"))).otherwise(F.col("attributes"))), info={"name": "n", "attributes": {}})
    found = lambda t: {r["code"]: r["count"] for r in lossiness.lossiness(ds, t).collect()}
    assert found("ir-json") == {}
    assert found("coco") == {"drop_dataset_info_name": 1, "coco_attributes_may_not_be_preserved": 2}
    assert found("via") == {"drop_dataset_info": 1, "drop_category_supercategory": 1, "drop_annotation_confidence": 1, "drop_annotation_attributes": 2}
    assert found("labelme")["drop_annotation_attributes"] == 1
    assert found("tfrecord")["drop_unused_categories"] == 1
    assert lossiness.output_counts(ds, "kaggle-wheat").first().asDict() == {"images": 2, "categories": 1, "annotations": 7}
    for t in lossiness.TARGETS:
        lossiness.is_lossy(ds, t)


def test_partial_attribute_lists_count_by_image(spark):
    ds = make(spark, [(1, "a", 9, 9, 0), (2, "b", 9, 9, 1)], [(1, "c", None, 0)], [(n, 1 + n // 2, 1, 1.0, 1.0, 2.0, 2.0, None) for n in range(4)])
    both = F.create_map(F.lit("area"), F.lit("1"), F.lit("difficult"), F.lit("1"))
    # one image has two attributes on one of its boxes, the other both on all
    marked = ds.changed(annotations=ds.annotations.withColumn("attributes", F.when(F.col("id") > 0, both).otherwise(F.create_map().cast("map<string,string>"))))
    assert [(r.code, r["count"]) for r in lossiness.lossiness(marked, "tfrecord").collect()] == [("drop_sparse_attributes", 1)]
