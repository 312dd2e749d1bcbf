"""Malformed JSON is refused, by readers and in ``parse_errors``, with the file and the place."""

import json

import pytest

from tessera.sources import FORMATS
from tessera.sources.strict import DOCUMENTS, LINES, SECTIONS, parse_errors

COCO = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}], "categories": [{"id": 1, "name": "x"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 2.5, 3, 4]}], "licenses": []}


def written(folder, text, name="d.json"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text if isinstance(text, str) else json.dumps(text))
    return str(folder)


def problems(spark, path, form):
    return sorted(r.problem for r in parse_errors(spark, path, form).collect())


def changed(section, **fields):
    return COCO | {section: [{k: v for k, v in (COCO[section][0] | fields).items() if v is not ...}]}


def test_fields_of_coco(spark, tmp_path):
    bad = {
        "wide": (changed("images", width="wide"), ".width isn't a count"), "minus": (changed("images", height=-1), ".height isn't a count"),
        "large": (changed("images", height=2**32), ".height isn't a count"), "quoted": (changed("annotations", image_id="1"), ".image_id isn't an id"),
        "three": (changed("annotations", bbox=[1, 2, 3]), ".bbox isn't a list of 4"), "text": (changed("annotations", bbox=[1, 2, "3", 4]), ".bbox[2] isn't a number"),
        "null": (changed("annotations", bbox=[1, 2, None, 4]), ".bbox[2] is missing, not a number"), "gone": (changed("categories", name=...), ".name is missing, not text"),
        "score": (changed("annotations", score="0.5"), ".score isn't a number"), "nolist": (COCO | {"images": {}}, "images isn't a list"),
        "nothing": ({k: v for k, v in COCO.items() if k != "annotations"}, "annotations is missing, not a list"), "element": (COCO | {"images": [5]}, " isn't an object"),
    }
    for name, (doc, _) in bad.items():
        written(tmp_path / "bad", doc, f"{name}.json")
    huge = json.dumps(COCO).replace("2.5", "1e999")
    written(tmp_path / "bad", huge, "huge.json"), written(tmp_path / "bad", COCO, "good.json"), written(tmp_path / "bad", json.dumps(COCO)[:-40], "cut.json")
    got = {}
    for r in parse_errors(spark, str(tmp_path / "bad"), "coco").collect():
        got.setdefault(r.path.split("/")[-1].removesuffix(".json"), []).append(r.problem)
    assert set(got) == set(bad) | {"huge", "cut"} and all(len(x) == 1 for x in got.values())
    for name, (_, end) in bad.items():
        assert got[name][0].endswith(end), name
    assert got["huge"][0].endswith(".bbox[1] isn't a number")
    for name in ("wide", "three", "nothing"):
        with pytest.raises(Exception, match=f"{name}.json: .*{bad[name][1].split('.')[-1].split('[')[0]}"):
            FORMATS["coco"].read(spark, written(tmp_path / name, bad[name][0], f"{name}.json"))
    fine = FORMATS["coco"].read(spark, written(tmp_path / "good", COCO))
    assert (fine.images.count(), fine.annotations.first().ymax) == (1, 6.5)


@pytest.mark.parametrize("form", sorted({*DOCUMENTS, *LINES, *SECTIONS}))
def test_cut_documents_of_every_format(spark, tmp_path, form):
    name = {"hf": "metadata.jsonl", "cityscapes": "d_gtFine_polygons.json"}.get(form, "d.jsonl" if form in LINES else "d.json")
    path = written(tmp_path / "x", '[{"image": "a.jpg", "size": 1' if isinstance(DOCUMENTS.get(form), list) else '{"image": "a.jpg", "shapes": [1', name)
    assert len(problems(spark, path, form)) == 1
    with pytest.raises(Exception, match="d.json|metadata.jsonl|d_gtFine"):
        ds = FORMATS[form].read(spark, path, **({"images": str(tmp_path)} if form == "ibm-cloud-annotations" else {}))
        ds.images.count(), ds.annotations.count()


def test_other_shapes(spark, tmp_path):
    cases = {
        "create-ml": [{"image": "a", "annotations": [{"label": "x", "coordinates": {"x": 1, "y": "2", "width": 3, "height": 4}}]}],
        "ibm-cloud-annotations": {"type": "localization", "annotations": {"a.jpg": [{"x": 0.1, "y": 0.1, "x2": "1", "y2": 1, "label": "x"}]}},
        "labelme": {"shapes": [{"label": "x", "points": [[1, 2], [3]]}]},
        "via": {"a": {"filename": 7}},
    }
    want = {"create-ml": "$[0].annotations[0].coordinates.y isn't a number", "ibm-cloud-annotations": "$.annotations.a.jpg[0].x2 isn't a number", "labelme": "$.shapes[0].points[1] isn't a list of 2", "via": "$.a.filename isn't text"}
    for form, doc in cases.items():
        assert problems(spark, written(tmp_path / form, doc), form) == [want[form]]
    twice = written(tmp_path / "twice", "[] []")
    assert problems(spark, twice, "create-ml") == ["$ isn't a JSON value"]
