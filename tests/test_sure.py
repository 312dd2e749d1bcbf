"""Elements and documents that certainly fit need no look as VARIANT; what might not fit does."""

import pytest

from tessera.sources import strict

FINE = '{"id":1,"image_id":2,"category_id":3,"bbox":[1,2.5,1e2,-4],"score":null,"more":{"a":[{}]}}'


def test_fitting_elements():
    find = strict.sure_section("coco")
    assert find("annotations", FINE) == "annotations" == find(None, FINE)
    assert find("annotations", FINE.replace("{}", '"' + "x" * 600 + '"')) == "annotations"
    assert find("images", FINE) is None and find("other", FINE) is None
    assert find(None, '{"id":1,"file_name":"a\\\\b","width":0,"height":4294967295}') == "images"


@pytest.mark.parametrize("a, b", [
    ('"id":1,', '"id":1.0,'), ('"id":1,', '"id":true,'), ('"id":1,', '"id":-1,'), ('"id":1,', '"id":9223372036854775808,'), ('"id":1,', '"id":1,"id":1,'), ('"id":1,', ""), ("1e2", "1e999"), ("1e2", "NaN"),
    ("1e2,", ""), ("1e2", '"1"'), ("null", "true"), ("{}", "{"), ("{}", "[" * 500 + "]" * 500), ("{}", "1" * 2000), ("{}", '"\\ud800"'), ("}}", "}} 1"), ("{}", '{"b":1,"b":2}'),
])
def test_what_isnt_sure(a, b):
    assert strict.sure_section("coco")("annotations", FINE.replace(a, b, 1) if a != "}}" else FINE + " 1") is None


def test_fitting_documents():
    fits = strict._fits(strict.DOCUMENTS["create-ml"])
    good = '[{"image":"a.jpg","annotations":[{"label":"x","coordinates":{"x":1,"y":2,"width":3,"height":4.5}}]},{"image":"b","annotations":null}]'
    assert strict._certain(good, fits) and strict._certain(good.replace("},", "},\n") * 1, fits)
    assert not strict._certain(good.replace("4.5", '"4"'), fits) and not strict._certain(good[:-1], fits) and not strict._certain(None, fits) and not strict._certain("", fits)
