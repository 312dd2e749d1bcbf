"""Formats with a file for each image: JSON, XML and plain text."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.geometry import Box, box, envelope, from_cxcywh, from_xywh, to_cxcywh, to_normalized
from tessera.model import AnnotationDataset, numbered
from tessera.storage import exists, stored

from .common import annotations_of, basename, carried, document_of, documents, fixed, from_raw, last_of_each, lines, looked_up, number, per_image, register, relative, require, shards_for, stem, write_files, write_images, write_lines, write_partitions
from .json_docs import _joined, _obj, _ord, _xywh
from .pictures import image_sizes, listing, sized, with_sizes
from .strict import json_documents

_NO_ATTRIBUTES = "map<string,string>"


def _parsed(spark: SparkSession, path: str, form: str, schema: str, glob: str = "*.json") -> DataFrame:
    docs = json_documents(spark, path, form, glob)
    return docs.select(relative(F.col("path"), path).alias("rel"), F.from_json("text", schema).alias("d")).select("rel", "d.*")


def _corner(x: Column, y: Column) -> Column:
    return F.array(x, y)


def _corners() -> Column:
    b = box()
    return F.array(_corner(b.xmin, b.ymin), _corner(b.xmax, b.ymin), _corner(b.xmax, b.ymax), _corner(b.xmin, b.ymax))


def _around(points: Column) -> Box:
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


@register("labelme", "JSON for each image")
class Labelme:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        rows = _parsed(spark, path, "labelme", "shapes array<struct<label:string,points:array<array<double>>,shape_type:string>>, imagePath string, imageHeight bigint, imageWidth bigint")
        extension = F.regexp_extract("imagePath", r"(\.[^.]*)$", 1)
        rows = rows.withColumn("file_name", F.concat(F.regexp_replace(F.regexp_replace("rel", r"^annotations/", ""), r"\.json$", ""), extension))
        a = rows.select("file_name", F.posexplode("shapes").alias("k", "x"))
        n = F.size("x.points")
        fine = ((F.coalesce("x.shape_type", F.lit("polygon")) == "rectangle") & (n == 2)) | ((F.coalesce("x.shape_type", F.lit("polygon")) == "polygon") & (n >= 3))
        a = a.withColumns({"label": require(fine, "a shape is neither a rectangle nor a polygon", F.col("x.label")), "_ord": _ord("file_name", "k"), "attributes": F.create_map(F.lit("labelme_shape_type"), F.coalesce("x.shape_type", F.lit("polygon")))})
        return from_raw(rows.select("file_name", F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height")), annotations_of(a, _around(F.col("x.points"))))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        b = box()
        i = per_image(ds, _obj(label=F.col("label"), points=F.array(_corner(b.xmin, b.ymin), _corner(b.xmax, b.ymax)), shape_type=F.lit("rectangle"), flags=F.create_map().cast(_NO_ATTRIBUTES)), "unknown")
        text = _joined(_obj(version=F.lit("5.0.0"), imagePath=F.concat(F.lit("../images/"), F.col("file_name")), imageHeight=F.col("height"), imageWidth=F.col("width")), shapes=F.col("items"))
        write_files(i.select(F.concat(F.lit("annotations/"), F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit(".json")).alias("name"), text.alias("content")), path)


@register("superannotate", "JSON for each image", "confidence")
class SuperAnnotate:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        p = "struct<x1:double,y1:double,x2:double,y2:double>"
        docs = json_documents(spark, path, "superannotate", "*.json")
        rows = docs.select(F.from_json("text", "metadata struct<name:string,width:bigint,height:bigint>, instances array<struct<type:string,className:string,probability:double,confidence:double,points:string>>").alias("d")).select("d.*")
        rows = rows.withColumn("file_name", F.col("metadata.name"))
        a = rows.select("file_name", F.posexplode("instances").alias("k", "x"))
        corners, listed = F.from_json("x.points", p), F.from_json("x.points", "array<double>")
        a = a.withColumns({"c": corners, "l": F.when(F.startswith(F.col("x.points"), F.lit("[")), listed), "label": F.col("x.className"), "confidence": F.coalesce("x.probability", "x.confidence"), "_ord": _ord("file_name", "k")})
        xs, ys = F.filter("l", lambda v, i: i % 2 == 0), F.filter("l", lambda v, i: i % 2 == 1)
        polygon = Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
        flat = Box(F.least("c.x1", "c.x2"), F.least("c.y1", "c.y2"), F.greatest("c.x1", "c.x2"), F.greatest("c.y1", "c.y2"))
        return from_raw(rows.select("file_name", "metadata.width", "metadata.height"), annotations_of(a, Box(*[F.coalesce(q, r) for q, r in zip(flat, polygon, strict=True)])))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        item = _obj(type=F.lit("bbox"), className=F.col("label"), probability=F.col("confidence"), points=F.struct(*[c.alias(n) for c, n in zip(box(), ("x1", "y1", "x2", "y2"), strict=True)]))
        i = per_image(ds, item)
        text = _joined(_obj(metadata=F.struct(F.col("file_name").alias("name"), "width", "height")), instances=F.col("items"))
        files = i.select(F.concat(F.lit("annotations/"), F.col("file_name"), F.lit(".json")).alias("name"), text.alias("content"))
        classes = ds.categories.agg(F.to_json(F.transform(F.array_sort(F.collect_set("name")), lambda n: F.struct(n.alias("name")))).alias("content"))
        write_files(files.union(classes.select(F.lit("classes/classes.json").alias("name"), "content")), path)


@register("supervisely", "JSON for each image")
class Supervisely:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        docs = json_documents(spark, path, "supervisely", "*.json")
        rows = docs.select(relative(F.col("path"), path).alias("rel"), F.from_json("text", "size struct<height:bigint,width:bigint>, objects array<struct<classTitle:string,geometryType:string,confidence:double,score:double,points:struct<exterior:array<array<double>>>>>").alias("d")).select("rel", "d.*")
        rows = rows.withColumn("file_name", F.regexp_replace(F.regexp_replace("rel", r"(^|/)ann/", ""), r"\.json$", ""))
        rows = rows.withColumn("file_name", F.regexp_replace("file_name", "^dataset", ""))
        a = rows.select("file_name", F.posexplode("objects").alias("k", "x"))
        n = F.size("x.points.exterior")
        fine = ((F.col("x.geometryType") == "rectangle") & (n == 2)) | ((F.col("x.geometryType") == "polygon") & (n >= 3))
        a = a.withColumns({"label": require(fine, "a geometry is neither a rectangle nor a polygon", F.col("x.classTitle")), "confidence": F.coalesce("x.confidence", "x.score"), "_ord": _ord("file_name", "k")})
        return from_raw(rows.select("file_name", "size.width", "size.height"), annotations_of(a, _around(F.col("x.points.exterior"))))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        b = box()
        exterior = F.array(_corner(b.xmin, b.ymin), _corner(b.xmax, b.ymax))
        item = _obj(id=F.col("id"), classTitle=F.col("label"), geometryType=F.lit("rectangle"), points=F.struct(exterior.alias("exterior"), F.array().cast("array<array<double>>").alias("interior")))
        i = per_image(ds, item)
        text = _joined(_obj(description=F.lit(""), size=F.struct("height", "width")), objects=F.col("items"))
        files = i.select(F.concat(F.lit("dataset/ann/"), F.col("file_name"), F.lit(".json")).alias("name"), text.alias("content"))
        classes = ds.categories.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_set("name")), lambda n: F.struct(n.alias("title"), F.lit("rectangle").alias("shape"))).alias("classes"))).alias("content"))
        write_files(files.union(classes.select(F.lit("meta.json").alias("name"), "content")), path)


# The labels of single things, and those that aren't things.
_INSTANCES = ("person", "rider", "car", "truck", "bus", "train", "motorcycle", "bicycle")
_SKIPPED = (
    "unlabeled", "ego vehicle", "rectification border", "out of roi", "static", "dynamic", "ground", "road", "sidewalk", "parking", "rail track", "building", "wall",
    "fence", "guard rail", "bridge", "tunnel", "pole", "polegroup", "traffic light", "traffic sign", "vegetation", "terrain", "sky", "license plate",
)


@register("cityscapes", "JSON for each image")
class Cityscapes:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        rows = _parsed(spark, path, "cityscapes", "imgHeight bigint, imgWidth bigint, objects array<struct<label:string,polygon:array<array<double>>,deleted:int>>", "*_gtFine_polygons.json")
        rows = rows.withColumn("file_name", F.concat(F.regexp_replace(F.regexp_replace("rel", r"^gtFine/", ""), r"_gtFine_polygons\.json$", ""), F.lit("_leftImg8bit.png")))
        a = rows.select("file_name", F.posexplode("objects").alias("k", "x")).where(F.coalesce("x.deleted", F.lit(0)) == 0)
        low = F.lower("x.label")
        a = a.where(~low.isin(*_SKIPPED) & (F.size("x.polygon") >= 3))
        many = F.endswith(low, F.lit("group")) & F.regexp_replace(low, "group$", "").isin(*_INSTANCES)
        kind = F.when(low.isin(*_INSTANCES), "instance").when(many, "group").otherwise("unknown")
        a = a.withColumns({"label": F.when(many, F.regexp_replace(low, "group$", "")).otherwise(F.col("x.label")), "attributes": F.create_map(F.lit("cityscapes_label_kind"), kind, F.lit("cityscapes_is_group"), many.cast("string")), "_ord": _ord("file_name", "k")})
        return from_raw(rows.select("file_name", F.col("imgWidth").alias("width"), F.col("imgHeight").alias("height")), annotations_of(a, _around(F.col("x.polygon"))))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, split: str = "train", city: str = "city") -> None:
        i = per_image(ds, _obj(label=F.col("label"), polygon=_corners()))
        text = _joined(_obj(imgHeight=F.col("height"), imgWidth=F.col("width")), objects=F.col("items"))
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("file_name", r"\.[^.]*$", ""), "_leftImg8bit$", ""), f"^{split}/{city}/", "")
        write_files(i.select(F.concat(F.lit(f"gtFine/{split}/{city}/"), plain, F.lit("_gtFine_polygons.json")).alias("name"), text.alias("content")), path)


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@register("voc", "XML for each image")
class Voc:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        obj = "array<struct<name:string,pose:string,truncated:string,difficult:string,occluded:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
        rows = documents(spark, path, "*.xml").select(F.from_xml("text", f"filename string, size struct<width:bigint,height:bigint,depth:bigint>, object {obj}").alias("d")).select("d.*").withColumnRenamed("filename", "file_name")
        depth = F.map_filter(F.create_map(F.lit("depth"), F.col("size.depth").cast("string")), lambda k, v: v.isNotNull())
        a = rows.select("file_name", F.posexplode("object").alias("k", "x"))
        kept = F.map_filter(F.create_map(*[x for k in ("pose", "truncated", "difficult", "occluded") for x in (F.lit(k), F.col(f"x.{k}"))]), lambda k, v: v.isNotNull())
        a = a.withColumns({"label": F.col("x.name"), "attributes": kept, "_ord": _ord("file_name", "k")})
        return from_raw(rows.select("file_name", "size.width", "size.height", depth.alias("attributes")), annotations_of(a, Box(*[F.col(f"x.bndbox.{k}") for k in Box._fields])))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        at = lambda k: F.try_element_at("attributes", F.lit(k))
        flag = lambda k: F.when(F.lower(at(k)).isin("true", "yes", "1"), "1").when(F.lower(at(k)).isin("false", "no", "0"), "0")
        tag = lambda name, value: F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))
        bounds = F.concat(*[tag(n, number(c)) for n, c in zip(Box._fields, box(), strict=True)])
        item = tag("object", F.concat(tag("name", _xml(F.col("label"))), tag("pose", _xml(at("pose"))), tag("truncated", flag("truncated")), tag("difficult", flag("difficult")), tag("occluded", flag("occluded")), tag("bndbox", bounds)))
        i = per_image(ds, item)
        size = tag("size", F.concat(tag("width", F.col("width").cast("string")), tag("height", F.col("height").cast("string")), tag("depth", F.coalesce(at("depth"), F.lit("3")))))
        text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<annotation>'), tag("filename", _xml(F.col("file_name"))), size, F.array_join("items", "\n"), F.lit("</annotation>\n"))
        write_files(i.select(F.concat(F.lit("Annotations/"), F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit(".xml")).alias("name"), text.alias("content")), path)


@register("cvat", "one XML document")
class Cvat:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        b = "array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double,_occluded:string,_z_order:string,_source:string,attribute:array<struct<_name:string,_VALUE:string>>>>"
        schema = f"meta struct<task:struct<labels:struct<label:array<struct<name:string,type:string>>>>>, image array<struct<_id:bigint,_name:string,_width:bigint,_height:bigint,box:{b},polygon:array<string>,points:array<string>>>"
        docs = documents(spark, path, "*").select(F.from_xml("text", schema, {"attributePrefix": "_"}).alias("d")).select("d.*")
        parsed = stored(docs.select(F.posexplode("image").alias("at", "i")).select("at", "i.*"))
        rows = parsed.withColumn("file_name", require(F.col("polygon").isNull() & F.col("points").isNull(), "an image has shapes that aren't boxes", F.col("_name")))
        a = rows.select("file_name", F.posexplode("box").alias("k", "x"))
        kept = F.map_filter(F.create_map(*[x for k in ("occluded", "z_order", "source") for x in (F.lit(k), F.col(f"x._{k}"))]), lambda k, v: v.isNotNull())
        own = last_of_each(F.transform("x.attribute", lambda t: F.struct(F.concat(F.lit("cvat_attr_"), require(F.btrim(t["_name"]) != "", "an attribute has no name", F.btrim(t["_name"]))).alias("key"), F.coalesce(F.btrim(t["_VALUE"]), F.lit("")).alias("value"))))
        a = a.withColumns({"label": F.col("x._label"), "attributes": F.map_concat(kept, own), "_ord": _ord("file_name", "k")})
        c = docs.select(F.explode("meta.task.labels.label").alias("l")).where("l.type is null or l.type in ('bbox', 'rectangle', 'any')").select(F.col("l.name").alias("name"))
        return from_raw(rows.select("file_name", F.col("_width").alias("width"), F.col("_height").alias("height"), F.col("at").alias("_ord")), annotations_of(a, Box(*[F.col(f"x._{k}") for k in ("xtl", "ytl", "xbr", "ybr")])), c, parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        at = lambda k, d: F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit(d))
        attr = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
        own = F.transform(F.array_sort(F.map_entries(carried("cvat_attr_"))), lambda e: F.concat(F.lit("<attribute"), attr("name", _xml(F.btrim(e["key"]))), F.lit(">"), _xml(e["value"]), F.lit("</attribute>")))
        item = F.concat(F.lit("<box"), attr("label", _xml(F.col("label"))), attr("source", _xml(at("source", "manual"))), attr("occluded", at("occluded", "0")), *[attr(n, number(c)) for n, c in zip(("xtl", "ytl", "xbr", "ybr"), box(), strict=True)], attr("z_order", at("z_order", "0")), F.lit(">"), F.array_join(own, ""), F.lit("</box>"))
        part = F.concat(F.lit("<image"), attr("id", F.col("id").cast("string")), attr("name", _xml(F.col("file_name"))), attr("width", F.col("width").cast("string")), attr("height", F.col("height").cast("string")), F.lit(">"), F.array_join("items", ""), F.lit("</image>"))
        # a document lists the labels of its own boxes
        n = shards or shards_for(ds)
        used = ds.annotations.select(document_of("image_id", n).alias("shard"), "category_id").join(looked_up(ds, "name"), F.col("category_id") == F.col("_cid")).select("shard", "name").distinct()
        label = F.concat(F.lit("<label><name>"), _xml(F.col("name")), F.lit("</name><type>bbox</type></label>"))
        first = used.select("shard", F.struct(F.col("name").alias("file_name"), F.lit(0).cast("long").alias("id")).alias("key"), label.alias("part"))
        head = '<?xml version="1.0" encoding="utf-8"?>\n<annotations><version>1.1</version><meta><task><labels>'
        write_images(ds, path, n, item, [(None, F.struct("file_name", "id"), part)], head, "</annotations>", between="", middles=("</labels></task></meta>",), beside=first)


@F.pandas_udf(T.DoubleType())
def _from_hex(text: pd.Series) -> pd.Series:
    """Doubles from sixteen hexadecimal digits, high byte first."""
    return text.map(lambda t: None if t is None else struct.unpack(">d", bytes.fromhex(t))[0])


@F.pandas_udf(T.StringType())
def _to_hex(value: pd.Series) -> pd.Series:
    return value.map(lambda v: struct.pack(">d", v).hex().upper())


@register("marmot", "XML for each page, coordinates as hexadecimal doubles, upwards from the page's crop box")
class Marmot:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        comp = "array<struct<_Label:string,_BBox:string>>"
        schema = f"_CropBox string, _PageNum string, Contents struct<Composites:array<struct<_Label:string,Composite:{comp}>>>"
        rows = documents(spark, path, "*.xml").select(relative(F.col("path"), path).alias("rel"), F.from_xml("text", schema, {"attributePrefix": "_"}).alias("d")).select("rel", "d.*")
        rows = rows.withColumn("file_name", F.regexp_replace("rel", r"\.xml$", ".png")).withColumn("crop", F.split("_CropBox", r"\s+"))
        c = [_from_hex(F.get("crop", F.lit(i))) for i in range(4)]
        rows = rows.select("file_name", "Contents", F.least(c[0], c[2]).alias("cx0"), F.greatest(c[0], c[2]).alias("cx1"), F.least(c[1], c[3]).alias("cy0"), F.greatest(c[1], c[3]).alias("cy1"))
        if images is not None:
            rows = with_sizes(rows, rows, spark, images).withColumns({"width": F.coalesce("width", F.round(F.col("cx1") - F.col("cx0")).cast("long")), "height": F.coalesce("height", F.round(F.col("cy1") - F.col("cy0")).cast("long"))})
        else:
            rows = rows.withColumns({"width": F.round(F.col("cx1") - F.col("cx0")).cast("long"), "height": F.round(F.col("cy1") - F.col("cy0")).cast("long")})
        a = rows.select("*", F.posexplode("Contents.Composites").alias("g", "s")).select("*", F.posexplode("s.Composite").alias("k", "x")).withColumn("b", F.split("x._BBox", r"\s+"))
        v = [_from_hex(F.get("b", F.lit(i))) for i in range(4)]
        a = a.withColumns({"v0": v[0], "v1": v[1], "v2": v[2], "v3": v[3], "label": F.coalesce("x._Label", "s._Label", F.lit("Composite")), "_ord": _ord("file_name", "g", "k")})
        sx, sy = F.col("width") / (F.col("cx1") - F.col("cx0")), F.col("height") / (F.col("cy1") - F.col("cy0"))
        x = [(F.col(n) - F.col("cx0")) * sx for n in ("v0", "v2")]
        y = [(F.col("cy1") - F.col(n)) * sy for n in ("v1", "v3")]
        return from_raw(rows.select("file_name", "width", "height"), annotations_of(a, Box(F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y))))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        b, h = box(), F.col("height").cast("double")
        item = F.struct(F.col("label").alias("l"), F.concat(F.lit('<Composite Label="'), _xml(F.col("label")), F.lit('" BBox="'), F.concat_ws(" ", *[_to_hex(c) for c in (b.xmin, h - b.ymin, b.xmax, h - b.ymax)]), F.lit('"></Composite>')).alias("t"))
        i = per_image(ds, item)
        groups = F.transform(F.array_sort(F.array_distinct(F.transform("items", lambda x: x["l"]))), lambda g: F.concat(F.lit('<Composites Label="'), _xml(g), F.lit('">'), F.array_join(F.transform(F.filter("items", lambda x: x["l"] == g), lambda x: x["t"]), ""), F.lit("</Composites>")))
        crop = F.concat_ws(" ", *[_to_hex(c) for c in (F.lit(0.0), h, F.col("width").cast("double"), F.lit(0.0))])
        text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Page CropBox="'), crop, F.lit('" PageNum="1"><Contents>'), F.array_join(groups, ""), F.lit("</Contents></Page>\n"))
        write_files(i.select(F.concat(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit(".xml")).alias("name"), text.alias("content")), path)


def _text_rows(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Non-blank lines with the label file they are from, its path below the root and the words of the line."""
    rows = lines(spark, path, glob).withColumn("rel", relative(F.col("path"), path))
    return rows.where(F.btrim("line") != "").withColumn("t", F.split(F.btrim("line"), r"\s+"))


def _num(i: int) -> Column:
    return F.get("t", F.lit(i)).cast("double")


def _sized_by_stem(spark: SparkSession, images: str) -> DataFrame:
    return image_sizes(spark, images).select(F.col("name").alias("file_name"), F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "^image_2/", "").alias("stem"), "width", "height")


@register("yolo", "text for each image, centres as shares", "confidence", "images")
class Yolo:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None, names: list[str] | None = None, split: str | None = None) -> AnnotationDataset:
        """``images`` is where the image files are, ``path``/images if not given; ``names`` the classes, read from data.yaml or classes.txt if not given.

        Where data.yaml names train, val or test, all of them are read, or the one that ``split``
        names; images get the split's name before theirs. A split is a folder of images, a folder
        with images and labels in it, or a text file that lists images. A label file without its
        image, a listed image that isn't there and two images of one name are errors.
        """
        root = path.rstrip("/")
        config = Yolo.config(spark, root)
        names = names or Yolo.names(spark, root, config)
        places = {} if images else _yaml_splits(config.get("data.yaml", ""))
        if split is not None and split not in places:
            raise ValueError(f"no split {split!r} here; there are: {', '.join(places) or 'none'}")
        info = None
        if places:
            wanted = [split] if split else list(places)
            info = {"attributes": {"yolo_layout_mode": "split_aware", "yolo_splits_found": ",".join(places), "yolo_splits_read": ",".join(wanted)}}
            base = _below(root, _yaml_value(config["data.yaml"], "path") or ".")
            parts = [_split(spark, base, s, places[s]) for s in wanted]
            sizes, rows = (reduce(DataFrame.unionByName, some) for some in zip(*parts, strict=True))
            sizes = sizes.groupBy("file_name").agg(F.first("stem").alias("stem"), F.first("width").alias("width"), F.first("height").alias("height"), F.count("*").alias("n"))
            sizes = sizes.select(require(F.col("n") == 1, F.concat(F.lit("two images are named "), F.col("file_name")), F.col("file_name")).alias("file_name"), "stem", "width", "height")
        else:
            sizes = _sized_by_stem(spark, images or f"{root}/images")
            rows = _labels(spark, f"{root}/labels")
        n = F.size("t")
        k = require((n == 5) | (n == 6), F.concat(F.lit("a line hasn't five or six fields: "), F.col("line")), F.get("t", F.lit(0)).cast("int"))
        rows = rows.withColumn("_class", k)
        listed = _name_table(spark, names) if names else None
        rows = rows if listed is None else rows.join(listed, F.col("_class") == F.col("_n"), "left")
        label = F.concat(F.lit("class_"), F.col("_class").cast("string")) if listed is None else require(F.col("name").isNotNull(), "a class isn't in the list of names", F.col("name"))
        # images that differ in their extension only: labels go to the first by name
        by_stem = sizes.groupBy("stem").agg(F.min(F.struct("file_name", "width", "height")).alias("i")).select("stem", "i.*")
        rows = rows.withColumns({"label": label, "confidence": F.when(n == 6, _num(5))}).join(by_stem, "stem", "left")
        rows = rows.withColumn("file_name", require(F.col("file_name").isNotNull(), F.concat(F.lit("labels without an image: "), F.col("stem")), F.col("file_name")))
        w, h = F.col("width"), F.col("height")
        a = annotations_of(rows.withColumn("_ord", F.struct("file_name", "_ord")), from_cxcywh(_num(1) * w, _num(2) * h, _num(3) * w, _num(4) * h))
        return from_raw(sizes.drop("stem"), a, None if listed is None else listed.select("name"), info)

    @staticmethod
    def config(spark: SparkSession, root: str) -> dict[str, str]:
        """The texts of data.yaml and classes.txt, where they are."""
        found = spark.read.format("binaryFile").option("pathGlobFilter", "{data.yaml,classes.txt}").load(root).select("path", F.decode("content", "UTF-8").alias("text"))
        return {r["path"].rsplit("/", 1)[-1]: r["text"] for r in found.collect()}

    @staticmethod
    def names(spark: SparkSession, root: str, config: dict[str, str] | None = None) -> list[str]:
        found = Yolo.config(spark, root) if config is None else config
        return _yaml_names(found.get("data.yaml", "")) or [x.strip() for x in found.get("classes.txt", "").splitlines() if x.strip()]

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        c = numbered(ds.categories.select("id", "name"), "id", start=0)
        w, h = F.col("width").cast("double"), F.col("height").cast("double")
        cx, cy, bw, bh = to_cxcywh(to_normalized(box(), w, h))
        item = F.concat_ws(" ", F.col("_class").cast("string"), *[fixed(x, 6) for x in (cx, cy, bw, bh)], F.when(F.col("confidence").isNotNull(), fixed(F.col("confidence"), 6)))
        i = per_image(_classed(ds, c), item)
        text = F.concat(F.array_join("items", "\n"), F.when(F.size("items") > 0, "\n").otherwise(""))
        files = i.select(F.concat(F.lit("labels/"), F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit(".txt")).alias("name"), text.alias("content"))
        write_files(files, path)
        head = ds.images.sparkSession.range(1).select(F.lit(-1).cast("long").alias("_n"), F.lit(f"nc: {c.count()}\nnames:\n").alias("content"))
        quoted = F.concat(F.lit("  "), F.col("_n").cast("string"), F.lit(": '"), F.replace(F.col("name"), F.lit("'"), F.lit("''")), F.lit("'\n"))
        _write_list(head.union(c.select("_n", quoted.alias("content"))), path, "data.yaml")


def _classed(ds: AnnotationDataset, c: DataFrame) -> AnnotationDataset:
    """``ds`` whose annotations have the number ``_class`` of their category, from categories numbered ``_n``; of equal ids the last counts."""
    place = c.groupBy(F.col("id").alias("_k")).agg(F.max("_n").alias("_class"))
    return ds.changed(annotations=ds.annotations.join(place, F.col("category_id") == F.col("_k"), "left").drop("_k"))


def _write_list(rows: DataFrame, root: str, name: str) -> None:
    """Rows (_n, content) as one file in order of ``_n``: the format has one list, which passes through a task as a stream."""
    write_partitions(rows.repartition(1).sortWithinPartitions("_n").select(F.encode("content", "UTF-8").alias("content")), root, name)


def _name_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """Rows (_n, name) of a list."""
    return spark.createDataFrame(list(enumerate(names)), "_n int, name string")


def _class_table(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows (_n, name) of the classes that data.yaml or classes.txt lists, the latter read as lines; none without a list."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "data.yaml").load(root).select(F.decode("content", "UTF-8").alias("text")).collect()
    names = _yaml_names(found[0]["text"]) if found else []
    if names or not exists(spark, f"{root}/classes.txt"):
        return _name_table(spark, names) if names else None
    rows = lines(spark, f"{root}/classes.txt").select(F.btrim("line", F.lit(" \t\r\x0b\x0c")).alias("name"), "_ord").where("name <> ''")
    listed = stored(numbered(rows, "_ord", start=0).select(F.col("_n").cast("int").alias("_n"), "name"))
    return None if listed.isEmpty() else listed


def _labels(spark: SparkSession, root: str) -> DataFrame:
    return _text_rows(spark, root).withColumn("stem", F.regexp_replace("rel", r"\.txt$", ""))


def _below(root: str, place: str) -> str:
    """A path in a configuration, seen from ``root`` unless it is absolute."""
    place = re.sub(r"^(\./)+|/(\.)?$", "", place.replace("\\", "/"))
    if place.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", place):
        return place
    at = root if place in ("", ".") else f"{root}/{place}"
    while (shorter := re.sub(r"/(?!\.\./)[^/]+/\.\.(?=/|$)", "", at, count=1)) != at:
        at = shorter
    return at


def _split(spark: SparkSession, base: str, split: str, place: str) -> tuple[DataFrame, DataFrame]:
    """A split's images (file_name, stem, width, height) and label lines with the stem of their image."""
    at = _below(base, place)
    if at.lower().endswith(".txt"):
        return _listed_split(spark, base, split, at)
    if exists(spark, f"{at}/images") and exists(spark, f"{at}/labels"):
        pictures, labels = f"{at}/images", f"{at}/labels"
    else:
        pictures, labels = at, _below(base, re.sub(r"(?i)^(.*(?:^|/))images(?=/|$)", r"\1labels", place.replace("\\", "/")))
        if labels == at or not exists(spark, labels):
            raise ValueError(f"split {split!r}: {at} isn't a folder of images with a folder of labels")
    put = lambda name: F.concat(F.lit(f"{split}/"), F.col(name)).alias(name)
    sizes = _sized_by_stem(spark, pictures).select(put("file_name"), put("stem"), "width", "height")
    rows = _labels(spark, labels)
    return sizes, rows.select(*[c for c in rows.columns if c != "stem"], put("stem"))


def _listed_split(spark: SparkSession, base: str, split: str, at: str) -> tuple[DataFrame, DataFrame]:
    """As ``_split``, for a text file with an image's path in each line; images and labels are looked up below ``base``."""
    own = at.rsplit("/", 1)[0]
    line = F.regexp_replace(F.replace(F.btrim("value"), F.lit("\\"), F.lit("/")), r"^(\./)+|(?<=/)(\./)+", "")
    listed = spark.read.text(at).select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    image = F.rlike("line", F.lit(r"(?i)\.(png|jpe?g|bmp|gif|webp|tiff?)$"))
    listed = listed.withColumn("line", require(image, F.concat(F.lit("not an image in the list: "), F.col("line")), F.col("line")))
    whole = F.when(F.col("line").startswith("/"), F.col("line")).otherwise(F.concat(F.lit(f"{own}/"), F.col("line")))
    tails = [F.regexp_extract("line", pattern, 1) for pattern in (rf"^(?:.*/)?images/{split}/(.+)$", r"^(?:.*/)?images/(.+)$", rf"^{split}/(.+)$")]
    tail = F.coalesce(*[F.when(t != "", t) for t in tails], F.when(F.col("line").startswith("/"), F.regexp_extract("line", r"[^/]+$", 0)).otherwise(F.col("line")))
    bare = F.regexp_replace("at", r"\.[^./]*$", "")
    listed = listed.select(F.concat(F.lit(f"{split}/"), tail).alias("file_name"), relative(whole, base).alias("at"))
    listed = listed.select("file_name", "at", F.concat(F.regexp_replace(bare, r"(?i)^(.*/|)images/", "$1labels/"), F.lit(".txt")).alias("apart"), F.concat(bare, F.lit(".txt")).alias("beside"))
    found = listed.join(listing(spark, base).select(F.col("name").alias("at"), F.lit(True).alias("found")), "at", "left")
    found = found.withColumn("at", require(F.col("found").isNotNull(), F.concat(F.lit("a listed image isn't there: "), F.col("at")), F.col("at")))
    sizes = sized(found, base, "at").select("file_name", F.col("file_name").alias("stem"), "width", "height")
    rows = _text_rows(spark, base)
    there = rows.select(F.col("rel").alias("apart")).distinct().withColumn("there", F.lit(True))
    places = listed.join(there, "apart", "left").select(F.col("file_name").alias("stem"), F.when(F.col("there"), F.col("apart")).otherwise(F.col("beside")).alias("rel"))
    # words are bound to the join's other side, so that no check of a line is made before it, on texts that aren't labels
    return sizes, rows.join(places, "rel").withColumn("t", F.when(F.col("stem").isNotNull(), F.col("t"))).select(*rows.columns, "stem")


def _plain_yaml(x: str) -> str:
    """A scalar without its quotes, or without a comment."""
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"":
        return x[1:-1].replace("''", "'")
    return re.split(r"\s#|^#", x)[0].strip()


def _yaml_value(text: str, key: str) -> str | None:
    m = re.search(rf"^{key}[ \t]*:[ \t]*(.*?)[ \t\r]*$", text, re.M)
    return (_plain_yaml(m[1]) or None) if m else None


def _yaml_splits(text: str) -> dict[str, str]:
    """The splits that a data.yaml names, with their places."""
    found = {k: _yaml_value(text, k) for k in ("train", "val", "test")}
    return {k: v for k, v in found.items() if v}


def _yaml_names(text: str) -> list[str]:
    """The names in a data.yaml: an inline list, or lines with a dash or a number."""
    m = re.search(r"^names\s*:(.*)((?:\n[ \t-].*|\n\s*)*)", text, re.M)
    if not m:
        return []
    plain = lambda x: x[1:-1].replace("''", "'") if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else x
    inline = m[1].strip()
    if inline.startswith("["):
        return [plain(x.strip()) for x in inline.strip("[]").split(",") if x.strip()]
    rows = [re.match(r"\s*(?:-|(\d+)\s*:)\s*(.*?)\s*$", x) for x in m[2].splitlines() if x.strip()]
    return [plain(r[2]) for r in sorted((r for r in rows if r), key=lambda r: int(r[1] or 0))]


def _keras(name: str) -> None:
    @register(name, "text, a line for each image", "images")
    class Keras:
        @staticmethod
        def read(spark: SparkSession, path: str, images: str | None = None, names: list[str] | None = None) -> AnnotationDataset:
            root = path.rstrip("/")
            listed = _name_table(spark, names) if names else _class_table(spark, root)
            rows = lines(spark, f"{root}/annotations").where(F.btrim("line") != "").withColumn("t", F.split(F.btrim("line"), r"\s+")).withColumn("file_name", F.get("t", F.lit(0)))
            a = rows.select("file_name", F.col("_ord").alias("at"), F.posexplode(F.slice("t", 2, 1 << 20)).alias("k", "b")).withColumn("v", F.split("b", ","))
            v = [F.get("v", F.lit(i)).cast("double") for i in range(5)]
            a = a.withColumn("_class", v[4].cast("int"))
            a = a.withColumn("name", F.lit(None).cast("string")) if listed is None else a.join(listed, F.col("_class") == F.col("_n"), "left")
            fine = (F.size("v") == 5) & (v[0] <= v[2]) & (v[1] <= v[3])
            a = a.withColumns({"label": F.coalesce("name", F.concat(F.lit("class_"), F.col("_class").cast("string"))), "_ord": F.struct("file_name", "at", "k")})
            a = a.withColumn("label", require(fine, "a box isn't five numbers in order", F.col("label")))
            i = rows.select("file_name", F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")).distinct()
            return from_raw(with_sizes(a, i, spark, images), annotations_of(a, Box(*v[:4])), None if listed is None else listed.select("name"))

        @staticmethod
        def write(ds: AnnotationDataset, path: str) -> None:
            root = path.rstrip("/")
            c = numbered(ds.categories.select("id", "name"), "id", start=0)
            i = per_image(_classed(ds, c), F.concat_ws(",", *map(number, box()), F.col("_class").cast("string")))
            name_ok = require(~F.rlike("file_name", F.lit(r"[\s,]")), "a file name has a blank or comma", F.col("file_name"))
            write_lines(i.withColumn("line", F.concat_ws(" ", name_ok, F.array_join("items", " "))), f"{root}/annotations", "file_name", "id")
            _write_list(c.select("_n", F.concat("name", F.lit("\n")).alias("content")), root, "classes.txt")


_keras("yolo-keras")
_keras("yolov4-pytorch")


@register("kitti", "text for each image", "confidence", "images")
class Kitti:
    #: The fields beside label and box, and what stands in for a missing one.
    FIELDS = (("truncated", 1, "0.00"), ("occluded", 2, "0"), ("alpha", 3, "-10.00"), ("dim_height", 8, "-1.00"), ("dim_width", 9, "-1.00"), ("dim_length", 10, "-1.00"), ("loc_x", 11, "-1000.00"), ("loc_y", 12, "-1000.00"), ("loc_z", 13, "-1000.00"), ("rotation_y", 14, "-10.00"))

    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        root = path.rstrip("/")
        rows = _text_rows(spark, f"{root}/label_2").withColumn("stem", F.regexp_replace("rel", r"\.txt$", ""))
        n = F.size("t")
        rows = rows.withColumns({"label": require((n == 15) | (n == 16), "a line hasn't 15 or 16 fields", F.get("t", F.lit(0))), "confidence": F.when(n == 16, _num(15))})
        rows = rows.withColumn("attributes", F.create_map(*[x for k, i, _ in Kitti.FIELDS for x in (F.lit(f"kitti_{k}"), F.get("t", F.lit(i)))]))
        files = documents(spark, f"{root}/label_2", "*.txt").select(F.regexp_replace(relative(F.col("path"), f"{root}/label_2"), r"\.txt$", "").alias("stem"))
        if images is not None:
            files = files.join(_sized_by_stem(spark, images), "stem", "left")
        else:
            files = files.select("stem", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))
        files = files.select("stem", F.coalesce("file_name", F.concat("stem", F.lit(".png"))).alias("file_name"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"))
        a = rows.join(files.select("stem", "file_name"), "stem").withColumn("_ord", F.struct("stem", "_ord"))
        return from_raw(files.drop("stem"), annotations_of(a, Box(_num(4), _num(5), _num(6), _num(7))))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        at = {k: F.coalesce(F.try_element_at("attributes", F.lit(f"kitti_{k}")), F.lit(d)) for k, _, d in Kitti.FIELDS}
        item = F.concat_ws(" ", F.col("label"), at["truncated"], at["occluded"], at["alpha"], *[fixed(c, 2) for c in box()], *[at[k] for k in ("dim_height", "dim_width", "dim_length", "loc_x", "loc_y", "loc_z", "rotation_y")], F.when(F.col("confidence").isNotNull(), fixed(F.col("confidence"), 2)))
        i = per_image(ds, item)
        plain = require(~F.contains("file_name", F.lit("/")), "a file name has a folder", F.regexp_replace("file_name", r"\.[^.]*$", ""))
        text = F.concat(F.array_join("items", "\n"), F.when(F.size("items") > 0, "\n").otherwise(""))
        write_files(i.select(F.concat(F.lit("label_2/"), plain, F.lit(".txt")).alias("name"), text.alias("content")), path)


@register("oidv4", "text for each image", "images")
class Oidv4:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        root = f"{path.rstrip('/')}/Label"
        rows = _text_rows(spark, root).withColumn("file_name", F.concat(F.regexp_replace("rel", r"\.txt$", ""), F.lit(".jpg")))
        rows = rows.withColumns({"label": require(F.size("t") == 5, "a line hasn't five fields", F.get("t", F.lit(0))), "_ord": F.struct("file_name", "_ord")})
        a = annotations_of(rows, Box(_num(1), _num(2), _num(3), _num(4)))
        files = documents(spark, root, "*.txt").select(F.concat(F.regexp_replace(relative(F.col("path"), root), r"\.txt$", ""), F.lit(".jpg")).alias("file_name"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))
        return from_raw(with_sizes(a, files, spark, images, guessed=True), a)

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        i = per_image(ds, F.concat_ws(" ", F.regexp_replace("label", r"\s+", "_"), *map(number, box())), "object")
        text = F.concat(F.array_join("items", "\n"), F.when(F.size("items") > 0, "\n").otherwise(""))
        write_files(i.select(F.concat(F.lit("Label/"), F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit(".txt")).alias("name"), text.alias("content")), path)


@register("wider-face", "text, a count of images and then blocks", "images")
class WiderFace:
    #: The numbers after a box.
    FIELDS = ("blur", "expression", "illumination", "invalid", "occlusion", "pose")

    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names, places, boxes = [], [], []
                for at, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                    rows = [x.strip() for x in text.splitlines() if x.strip()]
                    i = 1
                    for _ in range(int(rows[0]) if rows else 0):
                        name, n = rows[i], int(rows[i + 1])
                        names.append(name), places.append(f"{at}:{len(places):012d}"), boxes.append(rows[i + 2 : i + 2 + n])
                        i += 2 + n
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.string()), pa.array(boxes, pa.list_(pa.string()))], ["file_name", "at", "boxes"])

        rows = stored(documents(spark, path, "*").mapInArrow(blocks, "file_name string, at string, boxes array<string>"))
        a = rows.select("file_name", "at", F.posexplode("boxes").alias("k", "line")).withColumn("t", F.split("line", r"\s+"))
        a = a.withColumns({"label": F.lit("face"), "attributes": F.map_filter(F.create_map(*[x for i, k in enumerate(WiderFace.FIELDS) for x in (F.lit(f"wider_face_{k}"), F.get("t", F.lit(4 + i)))]), lambda k, v: v.isNotNull()), "_ord": _ord("at", "k")})
        i = rows.select("file_name", F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")).distinct()
        return from_raw(with_sizes(a, i, spark, images), annotations_of(a, from_xywh(*[_num(i) for i in range(4)])), spark.createDataFrame([("face",)], "name string"))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        v = _xywh()
        more = [F.coalesce(F.try_element_at("attributes", F.lit(f"wider_face_{k}")), F.lit("0")) for k in WiderFace.FIELDS]
        i = per_image(ds, F.concat_ws(" ", *[number(v[k]) for k in ("x", "y", "width", "height")], *more), "face")
        part = F.concat_ws("\n", F.col("file_name"), F.size("items").cast("string"), F.when(F.size("items") > 0, F.array_join("items", "\n")))
        shards = shards or shards_for(ds)
        shard = F.pmod(F.xxhash64(F.struct("file_name", "id")), F.lit(shards)).cast("int")
        rows = i.select(shard.alias("shard"), F.struct("file_name", "id").alias("key"), part.alias("value"))
        # a document begins with its number of images: a row without a key, which sorts first
        counts = ds.images.select(shard.alias("shard")).groupBy("shard").agg(F.count("*").cast("string").alias("value")).select("shard", F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "value")
        rows.union(counts).repartitionById(shards, "shard").sortWithinPartitions(F.asc_nulls_first("key")).select("value").write.text(path)
