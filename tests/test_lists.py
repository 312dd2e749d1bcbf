"""Lists of categories in documents and lines: they grow with what stands there, not with all categories everywhere."""

import json

import pytest

from tessera.model import dataset
from tessera.plans.roundtrips import boxes_of
from tessera.sources import FORMATS, json_docs

CATEGORIES, IMAGES = 300, 24


@pytest.fixture(scope="module")
def ds(spark):
    images = spark.createDataFrame([(i, f"i{i:03}.jpg", 100, 80, i) for i in range(IMAGES)], "id long, file_name string, width long, height long, _ord long")
    categories = spark.createDataFrame([(k, f'c"{k}é', None, k) for k in range(CATEGORIES)], "id long, name string, supercategory string, _ord long")
    rows = [(n, n // 2, n % 7 * 40, 1.0, 2.0, 3.0 + n % 5, 4.0, n) for n in range(2 * IMAGES)]
    return dataset(images, categories, spark.createDataFrame(rows, "id long, image_id long, category_id long, xmin double, ymin double, xmax double, ymax double, _ord long"))


def same(spark, ds, name, path):
    assert sorted(boxes_of(FORMATS[name].read(spark, path)).collect()) == sorted(boxes_of(ds).collect())


def test_lines_name_their_own_classes(spark, ds, tmp_path):
    at = str(tmp_path / "s")
    FORMATS["sagemaker"].write(ds, at)
    maps = [json.loads(r.value)["bounding-box-metadata"]["class-map"] for r in spark.read.text(at).collect()]
    assert sum(map(len, maps)) <= 2 * IMAGES + CATEGORIES
    assert {int(k): v for m in maps for k, v in m.items()} == {k: f'c"{k}é' for k in range(CATEGORIES)}
    same(spark, ds, "sagemaker", at)


LISTS = {
    "datumaro": lambda d: [x["name"] for x in d["categories"]["label"]["labels"]], "vott-json": lambda d: [x["name"] for x in d["tags"]],
    "coco": lambda d: [x["name"] for x in d["categories"]], "ir-json": lambda d: [x["name"] for x in d["categories"]],
}


@pytest.mark.parametrize("name", LISTS)
def test_documents_list_their_own_categories(spark, ds, tmp_path, name):
    at = str(tmp_path / "d")
    FORMATS[name].write(ds, at, shards=5)
    lists = [LISTS[name](json.loads(p.read_text())) for p in (tmp_path / "d").glob("part-*")]
    assert sum(map(len, lists)) <= 2 * IMAGES + CATEGORIES
    assert {x for names in lists for x in names} == {f'c"{k}é' for k in range(CATEGORIES)}
    same(spark, ds, name, at)


@pytest.mark.parametrize("name", ["openlabel", "datumaro"])
def test_labels_are_joined_to_boxes(spark, ds, tmp_path, monkeypatch, name):
    at, seen = str(tmp_path / "o"), []
    FORMATS[name].write(ds, at, shards=2)
    own = json_docs.from_raw
    monkeypatch.setattr(json_docs, "from_raw", lambda i, a, *more, **kw: seen.append(a) or own(i, a, *more, **kw))
    same(spark, ds, name, at)
    assert "Join" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
