"""What JSON documents must look like: shapes of fields by type, and the problems of documents that don't fit.

Documents are parsed as VARIANT, which keeps each value's type: a number in quotes isn't a number. Problems
name the field, as in ``annotations[3].bbox[0]``. A reader asks for ``checked`` rows and fails with the file
and the first problem; ``parse_errors`` lists all problems of all files instead.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lines
from .elements import Elements, bounds, elements

TEXT, COUNT, ID, NUMBER, ANY = "text", "a count", "an id", "a number", "anything"
POINT = (NUMBER, NUMBER)
#: The largest counts and ids that the formats know.
_MOST = {COUNT: 2**32 - 1, ID: 2**63 - 1}


@dataclass(frozen=True)
class Maybe:
    """A field that may be missing or null."""

    shape: object


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _get(v: Column, key: str | int) -> Column:
    return F.try_variant_get(v, f"$[{key}]" if isinstance(key, int) else f"$['{key}']", "variant")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is(v: Column, kind: str) -> Column:
    name = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    if kind == TEXT:
        return name == "STRING"
    if kind == NUMBER:
        kinds = _once(name, lambda x: (x == "BIGINT") | (x == "DOUBLE") | F.startswith(x, F.lit("DECIMAL")))
        return F.coalesce(kinds & (F.abs(F.try_variant_get(v, "$", "double")) < float("inf")), F.lit(False))
    return F.coalesce((name == "BIGINT") & F.try_variant_get(v, "$", "bigint").between(0, _MOST[kind]), F.lit(False))


def problems(v: Column, shape, place: Column) -> Column:
    """The ways in which a VARIANT doesn't fit ``shape``, as an array of texts that begin with ``place``.

    Shapes: a kind of value; ``Maybe``; a dict of fields (``*``: all that there are); a list of one shape;
    a tuple of shapes for an array of exactly so many values.
    """
    none = F.array().cast("array<string>")
    missing = v.isNull() | F.is_variant_null(v)

    def unless(ok: Column, what: str, rest: Column = none) -> Column:
        return F.when(ok, rest).otherwise(F.array(F.concat(place, F.when(missing, " is missing, not ").otherwise(" isn't "), F.lit(what))))

    def part(inner, name: str):
        return lambda x: problems(x, inner, F.concat(place, F.lit(name)))

    if isinstance(shape, Maybe):
        return F.when(missing, none).otherwise(problems(v, shape.shape, place))
    if isinstance(shape, dict) and "*" in shape:
        each = lambda x: problems(x["value"], shape["*"], F.concat(place, F.lit("."), x["key"]))
        return _once(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda items: unless(items.isNotNull(), "an object", F.flatten(F.transform(items, each))))
    if isinstance(shape, dict):
        parts = [_once(_get(v, k), part(s, f".{k}")) for k, s in shape.items()]
        return unless(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), "an object", F.flatten(F.array(*parts)) if parts else none)
    if isinstance(shape, list):
        each = lambda x, i: problems(x, shape[0], F.concat(place, F.lit("["), i.cast("string"), F.lit("]")))
        return _once(_items(v), lambda items: unless(items.isNotNull(), "a list", F.flatten(F.transform(items, each))))
    if isinstance(shape, tuple):
        parts = lambda items: F.flatten(F.array(*[_once(F.get(items, F.lit(i)), part(s, f"[{i}]")) for i, s in enumerate(shape)]))
        return _once(_items(v), lambda items: unless(F.coalesce(F.size(items) == len(shape), F.lit(False)), f"a list of {len(shape)}", parts(items)))
    return none if shape == ANY else unless(_is(v, shape), shape)


def text_problems(text: Column, shape, place: Column) -> Column:
    """The problems of a JSON text that holds one value."""
    # between brackets, so that what goes on after a value is seen
    parsed = _items(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    found = lambda items: problems(F.get(items, F.lit(0)), shape, place)
    return _once(parsed, lambda x: F.when(F.coalesce(F.size(x) == 1, F.lit(False)), found(x)).otherwise(F.array(F.concat(place, F.lit(" isn't a JSON value")))))


def _distinct(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a name stands twice")
    return out


def _refused(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_distinct, parse_constant=_refused)
#: Lengths of texts, depths and characters between brackets, commas and quotes beyond which nothing is sure; far below the limits of the JVM's parser.
_SURE_LENGTH, _SURE_DEPTH, _SURE_GAP = 8_000_000, 400, 900


def _parsed(text: str) -> object:
    """A JSON text's value; an error where the JVM's parser might see another one, or none."""
    if "\\u" in text or len(text) > _SURE_LENGTH:
        raise ValueError("not sure")
    if len(text) < _SURE_DEPTH:
        deep = False
    elif len(text) < _SURE_GAP:
        deep = text.count("[") + text.count("{") > _SURE_DEPTH
    else:
        depth, gap = bounds(text.encode())
        deep = depth > _SURE_DEPTH or gap > _SURE_GAP
    if deep:
        raise ValueError("not sure")
    return _DECODER.decode(text)


def _fits(shape) -> Callable[[object], bool]:
    """Whether a parsed value certainly has no ``problems``."""
    if isinstance(shape, Maybe):
        inner = _fits(shape.shape)
        return lambda v: v is None or inner(v)
    if isinstance(shape, dict) and "*" in shape:
        each = _fits(shape["*"])
        return lambda v: type(v) is dict and all(map(each, v.values()))
    if isinstance(shape, dict):
        fields = [(k, _fits(s)) for k, s in shape.items()]
        return lambda v: type(v) is dict and all(f(v.get(k)) for k, f in fields)
    if isinstance(shape, list):
        item = _fits(shape[0])
        return lambda v: type(v) is list and all(map(item, v))
    if isinstance(shape, tuple):
        places = [_fits(s) for s in shape]
        return lambda v: type(v) is list and len(v) == len(places) and all(f(x) for f, x in zip(places, v, strict=True))
    if shape == ANY:
        return lambda v: True
    if shape == TEXT:
        return lambda v: type(v) is str
    if shape == NUMBER:
        return lambda v: (type(v) is int and -(2**63) <= v < 2**63) or (type(v) is float and abs(v) < 1e300)
    most = _MOST[shape]
    return lambda v: type(v) is int and 0 <= v <= most


def _certain(text: str | None, fits: Callable[[object], bool]) -> bool:
    try:
        return text is not None and fits(_parsed(text))
    except (ValueError, RecursionError):
        return False


def sure(shape) -> Callable[[Column], Column]:
    """Whether a JSON text certainly fits a shape. Most do, so that few are looked at as VARIANT, which takes ten times as long and names the problems."""

    @F.pandas_udf("boolean")
    def certain(texts: pd.Series) -> pd.Series:
        fits, collecting = _fits(shape), gc.isenabled()
        # parsed values hold no cycles: looking for them while millions are made takes a third of the time
        gc.disable()
        try:
            return pd.Series([_certain(t, fits) for t in texts], dtype=bool)
        finally:
            if collecting:
                gc.enable()

    return certain


def sure_section(form: str) -> Callable[[str | None, str], str | None]:
    """The list of a format that an element certainly fits in: its own ``section`` or, where that isn't known yet, the first one."""
    shapes = {k: s.shape if isinstance(s, Maybe) else s for k, s in SECTIONS[form].items()}

    def find(section: str | None, text: str) -> str | None:
        if section is not None and section not in shapes:
            return None
        try:
            value = _parsed(text)
        except (ValueError, RecursionError):
            return None
        for name in shapes if section is None else (section,):
            fits = compiled.get(name) or compiled.setdefault(name, _fits(shapes[name]))
            if fits(value):
                return name
        return None

    compiled: dict[str, Callable] = {}
    return find


#: Shapes of which only the outer objects are given, as types that a VARIANT between brackets is cast to.
_OUTER = {"{}": "array<map<string,variant>>", "[{}]": "array<array<map<string,variant>>>"}


def fits_outside(text: Column, shape) -> Column | None:
    """Whether a JSON text has the outer objects that a shape asks for; None if it asks for more. One parse as VARIANT, a third of ``sure``'s time for large documents."""
    kind = _OUTER.get(str(shape))
    if kind is None:
        return None
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", kind)
    whole = lambda x: ~F.exists(x, lambda v: v.isNull())
    fine = lambda x: (F.size(x) == 1) & whole(x) & (whole(F.get(x, F.lit(0))) if isinstance(shape, list) else F.lit(True))
    return F.coalesce(_once(items, fine), F.lit(False))


def _fitting(text: Column, found: Column, name: Column) -> Column:
    """``text``, or an error that names the file and the first of the problems found.

    It stands in for the text itself, not in a filter, which Spark may put after others that drop the row.
    """
    error = lambda x: F.raise_error(F.concat(name, F.lit(": "), F.get(x, F.lit(0)))).cast("string")
    return F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) == 0, text).otherwise(error(x))), F.lit(0))


def checked(rows: DataFrame, shape, text: str = "text", place: Column | None = None, aside: Column | None = None, large: bool = False) -> DataFrame:
    """``rows`` whose ``text`` is an error, with the file and the first problem, where its JSON doesn't fit; those ``aside`` aren't looked at. Texts may be ``large``."""
    found = text_problems(F.col(text), shape, F.lit("$") if place is None else place)
    fine = F.col("_sure") if aside is None else aside | F.col("_sure")
    found = F.when(fine, F.array().cast("array<string>")).otherwise(found)
    outside = fits_outside(F.col(text), shape) if large else None
    return rows.withColumn("_sure", sure(shape)(F.col(text)) if outside is None else outside).withColumn(text, _fitting(F.col(text), found, F.col("path"))).drop("_sure")


_LIST = [ANY]
_XYWH = {"x": NUMBER, "y": NUMBER, "width": NUMBER, "height": NUMBER}
_CATEGORY = {"id": ID, "name": TEXT, "supercategory": Maybe(TEXT)}
_LICENSE = {"id": ID, "name": TEXT, "url": Maybe(TEXT)}
_IMAGE = {"id": ID, "file_name": TEXT, "width": COUNT, "height": COUNT, "date_captured": Maybe(TEXT)}
_REFERS = {"id": ID, "image_id": ID, "category_id": ID}
#: Formats whose document holds lists at its top: the shapes of their elements; the lists without ``Maybe`` must be there.
SECTIONS = {
    "ir-json": {
        "images": _IMAGE | {"license_id": Maybe(ID), "attributes": Maybe({"*": TEXT})}, "categories": _CATEGORY, "licenses": Maybe(_LICENSE),
        "annotations": _REFERS | {"bbox": dict.fromkeys(("xmin", "ymin", "xmax", "ymax"), NUMBER), "confidence": Maybe(NUMBER), "attributes": Maybe({"*": TEXT})},
    },
    "coco": {
        "images": _IMAGE | {"license": Maybe(ID)}, "categories": _CATEGORY, "licenses": Maybe(_LICENSE),
        "annotations": _REFERS | {"bbox": (NUMBER,) * 4, "area": Maybe(NUMBER), "iscrowd": Maybe(COUNT), "score": Maybe(NUMBER)},
    },
}
#: Formats of whole documents, and of one document for each image. Where a format lets odd objects be, only what holds them is given.
DOCUMENTS = {
    "create-ml": [{"image": TEXT, "annotations": Maybe([{"label": TEXT, "coordinates": _XYWH}])}],
    "bdd100k": [{}], "v7-darwin": [{}], "label-studio": [{"data": {}}], "scale-ai": [{}],
    "ibm-cloud-annotations": {"type": TEXT, "labels": Maybe([TEXT]), "annotations": {"*": [{"x": NUMBER, "y": NUMBER, "x2": NUMBER, "y2": NUMBER, "label": TEXT}]}},
    "datumaro": {"items": _LIST}, "edge-impulse": {}, "via": {"*": {"filename": TEXT}}, "vott-json": {}, "openlabel": {"openlabel": {}}, "unity-perception": {},
    "labelme": {"shapes": [{"label": TEXT, "points": [POINT], "shape_type": Maybe(TEXT)}], "imagePath": Maybe(TEXT), "imageWidth": Maybe(COUNT), "imageHeight": Maybe(COUNT)},
    "superannotate": {"metadata": {"width": COUNT, "height": COUNT}, "instances": [{}]},
    "supervisely": {"size": {"width": COUNT, "height": COUNT}, "objects": [{"classTitle": TEXT}]},
    "cityscapes": {"imgWidth": COUNT, "imgHeight": COUNT, "objects": [{"label": TEXT, "polygon": Maybe([POINT])}]},
}
#: Formats of JSON lines.
LINES = {"labelbox": {"data_row": Maybe({})}, "sagemaker": {}, "hf": {"file_name": TEXT, "width": Maybe(COUNT), "height": Maybe(COUNT)}}
#: Files beside the documents that aren't of their shape.
ASIDE = {"superannotate": "classes.json", "supervisely": "meta.json"}


def json_documents(spark: SparkSession, path: str, form: str, glob: str = "*") -> DataFrame:
    """Rows (path, text) of the documents of a format, each with the shape that the format asks for."""
    rows = documents(spark, path, glob)
    if form not in ASIDE:
        return checked(rows, DOCUMENTS[form], large=True)
    aside = F.col("path").endswith(ASIDE[form])
    return checked(rows.where(~aside), DOCUMENTS[form], aside=aside)


def _line() -> Column:
    return F.concat(F.lit("line "), F.substring("line", 1, 40))


def json_lines(spark: SparkSession, path: str, form: str, glob: str = "*") -> DataFrame:
    """Rows (line, path, _ord) of the lines that aren't blank, each with the shape that the format asks for."""
    return checked(lines(spark, path, glob).where(F.btrim("line") != ""), LINES[form], "line", _line())


def _missing(e: Elements, form: str) -> DataFrame:
    """Rows (path, problem): broken documents, and lists that documents lack or that aren't lists."""
    shapes = SECTIONS[form]
    here = e.sections.where(F.col("section").isin(*shapes))
    odd = here.where("container <> '['").select("path", F.concat("section", F.lit(" isn't a list")).alias("problem"))
    wanted = F.array(*[F.lit(s) for s, shape in shapes.items() if not isinstance(shape, Maybe)])
    lacking = e.files.join(e.broken, "path", "left_anti").select("path", F.explode(wanted).alias("section")).join(here, ["path", "section"], "left_anti")
    return e.broken.unionByName(odd).unionByName(lacking.select("path", F.concat("section", F.lit(" is missing, not a list")).alias("problem")))


def _element_problems(form: str) -> Column:
    """The problems of a row of ``elements``: none where its section has no shape."""
    found = F.array().cast("array<string>")
    for section, shape in SECTIONS[form].items():
        place = F.concat(F.lit(f"{section} at "), F.col("start").cast("string"), F.lit("+"), F.col("place").cast("string"))
        own = (F.col("section") == section) & (F.col("container") == "[")
        found = F.when(own & (F.col("sure") == section), F.array().cast("array<string>")).when(own, text_problems(F.col("text"), shape.shape if isinstance(shape, Maybe) else shape, place)).otherwise(found)
    return found


def json_sections(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Rows (path, section, container, start, place, text, part) of a format's documents, all of which have been checked.

    Documents may be of any size: tasks share each file. The error is the first one by path and place.
    """
    e = elements(spark, path, 2, sure=sure_section(form))
    bad = _missing(e, form).orderBy("path", "problem").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].path}: {bad[0].problem}")
    found = e.rows.where("sure is null or sure <> section").select("path", "start", "place", F.get(_element_problems(form), F.lit(0)).alias("problem")).where("problem is not null")
    first = found.orderBy("path", "start", "place").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].path}: {first[0].problem}")
    return e.rows.drop("sure")


def parse_errors(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Rows (path, problem): all problems of the JSON documents of a format, none where a reader would read them."""
    if form in SECTIONS:
        e = elements(spark, path, 2, sure=sure_section(form))
        return _missing(e, form).unionByName(e.rows.where("sure is null or sure <> section").select("path", F.explode(_element_problems(form)).alias("problem")))
    if form in LINES:
        rows = lines(spark, path).where(F.btrim("line") != "")
        rows = rows.where(~sure(LINES[form])(F.col("line")))
        return rows.select("path", F.explode(text_problems(F.col("line"), LINES[form], _line())).alias("problem"))
    rows = documents(spark, path, "*")
    if form in ASIDE:
        rows = rows.where(~F.col("path").endswith(ASIDE[form]))
    rows = rows.where(~sure(DOCUMENTS[form])(F.col("text")))
    return rows.select("path", F.explode(text_problems(F.col("text"), DOCUMENTS[form], F.lit("$"))).alias("problem"))
