"""Elements of JSON documents, cut the same however files are split."""

import json
import random

import pytest

from tessera.sources.elements import elements


def odd_text(rng):
    return rng.choice(['a}b', 'quote " here', "back\\slash", '\\"}', "[,]{", "é日", "", "\n\t", "}}}}", "\\"])


def coco(rng, n):
    thing = lambda i: {"id": i, "name": odd_text(rng), "deep": [{"x": [1, {"y": odd_text(rng)}]}] * rng.randrange(3), "n": rng.random()}
    return {"info": {"year": 2020, "note": odd_text(rng)}, "version": "1.0", "images": [thing(i) for i in range(n)], "empty": [], "nothing": {}, "annotations": [thing(i) for i in range(2 * n)], "last": 7}


@pytest.fixture
def small_ranges(spark):
    """Text is split into ranges of a few bytes."""
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def found(spark, path, level):
    e = elements(spark, str(path), level)
    return e.rows.orderBy("path", "start", "place").collect(), e.broken.collect()


def test_elements_of_sections(spark, tmp_path, small_ranges):
    doc = coco(random.Random(4), 8)
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1, ensure_ascii=False), encoding="utf-8")
    for size in (1 << 20, 400):
        small_ranges(size)
        rows, broken = found(spark, tmp_path, 2)
        assert broken == []
        got = {}
        for r in rows:
            got.setdefault((r.section, r.container), []).append(r.text)
        assert [json.loads(x) for x in got["images", "["]] == doc["images"]
        assert [json.loads(x) for x in got["annotations", "["]] == doc["annotations"]
        assert json.loads("{" + ",".join(got["info", "{"]) + "}") == doc["info"]
        assert [json.loads(x) for x in got["version", ""] + got["last", ""]] == ["1.0", 7]
        assert len(got) == 5


def test_elements_of_arrays_and_objects(spark, tmp_path, small_ranges):
    rng = random.Random(6)
    things = [{"k": odd_text(rng), "v": [{"w": odd_text(rng)}] * rng.randrange(3)} for _ in range(20)] + [None, 5, "x}", []]
    rng.shuffle(things)
    (tmp_path / "list").mkdir(), (tmp_path / "map").mkdir()
    (tmp_path / "list" / "a.json").write_text("﻿" + json.dumps(things) + "\n ", encoding="utf-8")
    (tmp_path / "list" / "b.json").write_text(" [ ] ")
    (tmp_path / "map" / "a.json").write_text(json.dumps({f"k}}{i}": x for i, x in enumerate(things)}))
    for size in (1 << 20, 200):
        small_ranges(size)
        rows, broken = found(spark, tmp_path / "list", 1)
        assert broken == [] and [json.loads(r.text) for r in rows] == things
        rows, broken = found(spark, tmp_path / "map", 1)
        assert broken == [] and [json.loads("{" + r.text + "}") for r in rows] == [{f"k}}{i}": x} for i, x in enumerate(things)]
        assert {r.container for r in rows} == {"{"}


def test_broken_documents(spark, tmp_path, small_ranges):
    whole = json.dumps(coco(random.Random(2), 6))
    cases = {"cut": whole[: len(whole) // 2], "almost": whole[:-1], "string": whole[: whole.index('"images') + 3], "twice": whole + whole, "after": whole + "x", "before": "x" + whole, "empty": "", "blank": " \n", "word": "null", "closes": whole + "}", "kinds": '{"a":[1,2}]', "fine": whole}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    for size in (1 << 20, 400):
        small_ranges(size)
        rows, broken = found(spark, tmp_path, 2)
        names = {r.path.split("/")[-1].removesuffix(".json"): r.problem for r in broken}
        assert set(names) == set(cases) - {"fine"}
        assert {r.path.split("/")[-1] for r in rows} == {"fine.json"}
        assert "string" in names["string"] and "brackets" in names["almost"] and "empty" in names["empty"]
