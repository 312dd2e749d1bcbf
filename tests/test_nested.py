"""Documents that list boxes by image are read without sorting or joining boxes; numbers and tables are as those of plain rows."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.model import dataset
from tessera.plans.roundtrips import boxes_of
from tessera.sources import FORMATS, strict
from tessera.sources.common import ahead, with_items, write_documents


def darwin(name, boxes, size=(None, None)):
    slots = [{"slot_name": "0", "width": size[0], "height": size[1], "source_files": []}]
    shapes = [{"name": n, "bounding_box": b and dict(zip("xywh", b, strict=True))} for n, b in boxes]
    return {"item": {"name": name, "slots": slots if size[0] else []}, "annotations": shapes}


B = (1.0, 2.0, 3.5, 4.0)


def test_numbers_of_lists(spark, tmp_path):
    """Images by name, the last of equal names counts; boxes as they stand, by path, also those of several tasks."""
    (tmp_path / "b.json").write_text(json.dumps([darwin("m", [("x", B)]), darwin("a", [("y", (0, 0, 9, 9)), ("x", None), ("x", B)], (7, 8)), darwin("z", [])]))
    (tmp_path / "a.json").write_text(json.dumps([darwin("z", [("w", B), (None, B)]), darwin("a", [("x", (0, 0, 50, 60))], (5, 6))]))
    ds = FORMATS["v7-darwin"].read(spark, str(tmp_path))
    assert [tuple(r) for r in ds.images.orderBy("id").select("id", "file_name", "width", "height").collect()] == [(1, "a", 7, 8), (2, "m", 5, 6), (3, "z", 5, 6)]
    assert [tuple(r) for r in ds.categories.orderBy("id").select("id", "name").collect()] == [(1, "w"), (2, "x"), (3, "y")]
    # the box without a label has a number and is left out
    assert [tuple(r) for r in ds.annotations.orderBy("id").select("id", "image_id", "category_id", "xmax").collect()] == [(1, 3, 1, 4.5), (3, 1, 2, 50.0), (4, 2, 2, 4.5), (5, 1, 3, 9.0), (6, 1, 2, 4.5)]
    assert sorted(boxes_of(ds).collect()) == sorted(boxes_of(ds.changed()).collect())
    assert ds.changed().named is None


def test_numbers_by_name(spark, tmp_path):
    e = lambda label, x: {"label": label, "x": x, "y": 1, "width": 2, "height": 3}
    (tmp_path / "p.json").write_text(json.dumps({"files": [{"path": "b", "boundingBoxes": [e("k", 5), e("j", 6), {"label": "k"}]}, {"path": "c"}], "boundingBoxes": {"d": [e("k", 7)], "a": [e("j", 8)]}}))
    ds = FORMATS["edge-impulse"].read(spark, str(tmp_path))
    assert [tuple(r) for r in ds.images.orderBy("id").select("id", "file_name", "width", "height").collect()] == [(1, "a", 10, 4), (2, "b", 8, 4), (3, "c", None, None), (4, "d", 9, 4)]
    assert [tuple(r) for r in ds.annotations.orderBy("id").select("id", "image_id", "category_id", "xmin").collect()] == [(1, 1, 1, 8.0), (2, 2, 2, 5.0), (3, 2, 1, 6.0), (4, 4, 2, 7.0)]


@pytest.mark.parametrize("name", ["v7-darwin", "edge-impulse"])
def test_boxes_are_not_joined(spark, tmp_path, name):
    images = spark.createDataFrame([(i, f"i{i:03}", 10, 20, i) for i in range(30)], "id long, file_name string, width long, height long, _ord long")
    categories = spark.createDataFrame([(1, 'c"é', None, 1), (2, "d", None, 2)], "id long, name string, supercategory string, _ord long")
    a = spark.createDataFrame([(n, n % 29, 1 + n % 2, 1.0, 2.0, 3.0 + n, 4.0, n) for n in range(100)], "id long, image_id long, category_id long, xmin double, ymin double, xmax double, ymax double, _ord long")
    ds = dataset(images, categories, a)
    FORMATS[name].write(ds, str(tmp_path / "d"), shards=4)
    read = FORMATS[name].read(spark, str(tmp_path / "d"))
    plan = boxes_of(read)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Join ") + plan.count("HashJoin") <= 2 * plan.count("BroadcastHashJoin")
    assert sorted(boxes_of(read).collect()) == sorted(boxes_of(ds).collect())
    assert read.images.count() == 30


def test_items_of_an_unknown_image(spark):
    images = spark.createDataFrame([(1, "a", 1)], "id long, file_name string, _ord long")
    ds = dataset(images, spark.createDataFrame([(1, "c", 1)], "id long, name string, _ord long"), spark.createDataFrame([(5, 1, 1, 1), (4, 1, 9, 2)], "id long, image_id long, category_id long, _ord long"))
    assert [(r.file_name, r["items"]) for r in with_items(ds, F.col("label"), "none").collect()] == [("a", ["none", "c"])]
    with pytest.raises(Exception, match="annotation 4 has no image"):
        with_items(ds.changed(images=images.where("id > 1")), F.col("label"), "none").collect()


def test_sums_ahead(spark):
    rows = spark.range(0, 30_000, 1, 1).withColumn("n", F.col("id") % 3)
    assert rows.withColumn("s", ahead(F.col("n"))).agg(F.max("s"), F.sum("s")).first() == (29_998, sum(sum(k % 3 for k in range(3)) * (i // 3) + (0, 0, 1)[i % 3] for i in range(30_000)))


def test_documents_without_python(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 2, 0, "c"), (2, 1, 5, "d"), (2, 1, 4, "e")], "shard int, section int, key long, part string")
    write_documents(rows, str(tmp_path / "d"), 4, "<", ">", middles=("|", "!"))
    assert sorted("".join(p.read_text().split()) for p in (tmp_path / "d").glob("part-*")) == sorted(["<|!>", "<a,b|!c>", "<|e,d!>"])
    write_documents(rows.limit(0), str(tmp_path / "e"), 3, "<", ">")
    assert ["".join(p.read_text().split()) for p in (tmp_path / "e").glob("part-*")] == ["<>"]


@pytest.mark.parametrize("text, array, whole", [
    ('[{"a":1},{}]', True, False), ("[]", True, False), ('{"a":[1]}', False, True), ("[{},null]", False, False), ("[{},1]", False, False), ("[{}", False, False), ("[{}] 1", False, False),
    ('[{"a":1,"a":2}]', False, False), ("{} {}", False, False), ("{},{}", False, False), ("null", False, False), ("", False, False), (None, False, False), ('[{"a":NaN}]', False, False),
])
def test_outer_objects(spark, text, array, whole):
    row = spark.createDataFrame([(text,)], "t string").select(strict.fits_outside(F.col("t"), [{}]), strict.fits_outside(F.col("t"), {})).first()
    assert tuple(row) == (array, whole)
    assert strict.fits_outside(F.col("t"), {"a": {}}) is None
