"""What round trips leave on disk and send around."""

import json
import os

import pytest

from tessera.model import dataset
from tessera.plans.roundtrips import boxes_of
from tessera.sources import FORMATS
from tessera.storage import CLEANUP, passing, stored


@pytest.fixture(scope="module")
def ds(spark):
    images = spark.createDataFrame([(i, f"i{i:03}.jpg", 100, 80, i) for i in range(40)], "id long, file_name string, width long, height long, _ord long")
    categories = spark.createDataFrame([(k, f"c{k % 3}", "x" if k % 2 else None, k) for k in range(60)], "id long, name string, supercategory string, _ord long")
    rows = [(n, n // 3, n * 7 % 60, 1.0, 2.0, 3.0 + n % 5, 4.0, n) for n in range(120)]
    return dataset(images, categories, spark.createDataFrame(rows, "id long, image_id long, category_id long, xmin double, ymin double, xmax double, ymax double, _ord long"))


def test_setting_lasts_no_longer_than_the_write(spark):
    was = spark.conf.get(CLEANUP)
    with pytest.raises(ZeroDivisionError), passing(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(CLEANUP) == was


def test_storing_leaves_no_shuffle_files(spark):
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for top in folder for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before = files()
    out = stored(spark.range(100_000).selectExpr("id", "id % 977 as k").repartition(7, "k").groupBy("k").count().repartition(3))
    assert not files() - before
    assert out.count() == 977


@pytest.mark.parametrize("name", ["datumaro", "vott-json"])
def test_lists_name_what_is_alike_once(spark, ds, tmp_path, name):
    at = str(tmp_path / "d")
    FORMATS[name].write(ds, at, shards=4)
    docs = [json.loads(p.read_text()) for p in (tmp_path / "d").glob("part-*")]
    lists = [[tuple(sorted(x.items())) for x in (d["categories"]["label"]["labels"] if name == "datumaro" else d["tags"])] for d in docs]
    assert all(len(x) == len(set(x)) for x in lists)
    assert {dict(x)["name"] for names in lists for x in names} == {"c0", "c1", "c2"}
    assert sorted(boxes_of(FORMATS[name].read(spark, at)).collect()) == sorted(boxes_of(ds).collect())


def test_one_shuffle_writes_documents(spark, ds, tmp_path, monkeypatch):
    from tessera.sources import common

    plans, own = [], common._write_parts
    monkeypatch.setattr(common, "_write_parts", lambda rows, *more: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or own(rows, *more))
    FORMATS["create-ml"].write(ds, str(tmp_path / "c"), shards=4)
    assert plans[0].count("Exchange shufflepartitionidpassthrough") == 1
    assert "Exchange hashpartitioning(image_id" not in plans[0]
    assert "Exchange hashpartitioning(shard" not in plans[0]


def test_named_boxes_are_joined_to_numbers_only(spark, ds, tmp_path):
    FORMATS["datumaro"].write(ds, str(tmp_path / "d"), shards=2)
    plan = boxes_of(FORMATS["datumaro"].read(spark, str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastHashJoin [_p") == 1


def test_types_of_objects_are_never_broadcast(spark, ds, tmp_path, monkeypatch):
    from tessera.sources import json_docs

    seen, own = [], json_docs.from_raw
    FORMATS["openlabel"].write(ds, str(tmp_path / "o"), shards=2)
    monkeypatch.setattr(json_docs, "from_raw", lambda i, a, *more, **kw: seen.append(a._jdf.queryExecution().executedPlan().toString()) or own(i, a, *more, **kw))
    FORMATS["openlabel"].read(spark, str(tmp_path / "o"))
    assert "SortMergeJoin" in seen[0] and "BroadcastHashJoin" not in seen[0]
