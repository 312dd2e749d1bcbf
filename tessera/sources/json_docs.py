"""Formats whose document is JSON: one for a dataset, or lines of it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, box, envelope, from_cxcywh, from_percent, from_xywh, rotated_envelope, to_cxcywh, to_normalized, to_percent, to_pixel
from tessera.model import INFO, AnnotationDataset, dataset, numbered
from tessera.storage import exists, paths_like, stored

from .common import (
    annotations_of, attribute, basename, carried, document_of, from_lists, from_raw, listed_categories, listed_names, per_image, prefixed, register, relative, require, shards_for, stem, with_items,
    write_documents, write_images, write_lines,
)
from .elements import in_section
from .pictures import with_sizes
from .strict import json_documents, json_lines, json_sections


def _obj(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k.rstrip("_")) for k, v in fields.items()]))


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _xywh(b: Box | None = None) -> dict[str, Column]:
    b = b or box()
    return dict(zip(("x", "y", "width", "height"), (b.xmin, b.ymin, b.xmax - b.xmin, b.ymax - b.ymin), strict=True))


def _ord(*places: str) -> Column:
    return F.struct(*[F.col(p) for p in places]).alias("_ord")


def _array_docs(spark: SparkSession, path: str, form: str, schema: str) -> DataFrame:
    """Elements of a format's documents that are arrays: rows (path, at, d), parsed once."""
    return stored(_parsed_docs(spark, path, form, schema))


def _parsed_docs(spark: SparkSession, path: str, form: str, schema: str) -> DataFrame:
    """Elements of a format's documents that are arrays: rows (path, at, d), parsed at each use."""
    return json_documents(spark, path, form).select("path", F.posexplode(F.from_json("text", f"array<struct<{schema}>>")).alias("at", "d"))


def _boxes(items: Column, kept, label: str, box: Callable[[Column], Box]) -> Column:
    """A list of labels and boxes of those ``items`` that are ``kept``."""
    found = F.transform(F.filter(items, kept), lambda x: F.struct(x[label].alias("label"), *box(x).named()))
    return F.coalesce(found, F.array().cast("array<struct<label:string,xmin:double,ymin:double,xmax:double,ymax:double>>"))


def _enveloped(shape: Column, key: str) -> Column:
    """Attributes that tell which boxes stand for polygons."""
    return F.when(shape, F.create_map(F.lit(key), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))


def _skipped(key: str, n: int) -> dict:
    """What to note in a dataset's info of ``n`` objects that were left out."""
    return {"attributes": {key: str(n)}} if n else {}


def _kinds(schema: str) -> dict[str, str]:
    """The types of a schema's fields, which stand apart by a comma and a blank."""
    return dict(x.split(" ", 1) for x in schema.split(", "))


def _rows_of(rows: DataFrame, schema: str, section: str) -> DataFrame:
    """Rows (path, _ord, fields) of one list of a document; ``schema`` has the document's lists."""
    kind = _kinds(schema)[section].removeprefix("array<").removesuffix(">")
    own = in_section(rows, section).where(F.col("container") == "[")
    return own.select("path", F.struct("start", "place").alias("_ord"), F.from_json("text", kind).alias("x")).select("path", "_ord", "x.*")


def _info_of(rows: DataFrame, schema: str) -> dict:
    """The known fields of a document's ``info``, of the first file that has one."""
    own = in_section(rows, "info").where("container = '{'").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "text"))), lambda x: x["text"]), ",").alias("j"))
    first = own.orderBy("path").limit(1).select(F.from_json(F.concat(F.lit("{"), "j", F.lit("}")), _kinds(schema)["info"]).alias("info")).collect()
    return {k: v for k, v in (first[0]["info"].asDict() if first and first[0]["info"] else {}).items() if v is not None}


def _listed(df: DataFrame, column: str) -> DataFrame:
    return df.select("path", F.posexplode(column).alias("_ord", "x")).select("path", "_ord", "x.*")


@register("ir-json", "the canonical model as JSON", "ids", "confidence", "attributes", "supercategory")
class IrJson:
    SCHEMA = (
        "info struct<name:string,version:string,description:string,url:string,year:bigint,contributor:string,date_created:string,attributes:map<string,string>>, licenses array<struct<id:bigint,name:string,url:string>>, "
        "images array<struct<id:bigint,file_name:string,width:bigint,height:bigint,license_id:bigint,date_captured:string,attributes:map<string,string>>>, categories array<struct<id:bigint,name:string,supercategory:string>>, "
        "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,confidence:double,attributes:map<string,string>>>"
    )

    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        rows = json_sections(spark, path, "ir-json")
        images, categories, licenses, annotations = (_rows_of(rows, IrJson.SCHEMA, x) for x in ("images", "categories", "licenses", "annotations"))
        a = annotations.select("id", "image_id", "category_id", "bbox.*", "confidence", "attributes", _ord("path", "_ord"))
        c = categories.groupBy("id", "name", "supercategory").agg(F.min(_ord("path", "_ord")).alias("_ord"))
        return dataset(images.withColumn("_ord", _ord("path", "_ord")).drop("path"), c, a, licenses.drop("path", "_ord").distinct(), _info_of(rows, IrJson.SCHEMA))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        none = lambda m: F.when(F.size(m) > 0, m)
        item = _obj(id=F.col("id"), image_id=F.col("image_id"), category_id=F.col("category_id"), bbox=F.struct(*box().named()), confidence=F.col("confidence"), attributes=none(F.col("attributes")))
        head = _obj(**{c: F.col(c) for c in ("id", "file_name", "width", "height", "license_id", "date_captured")}, attributes=none(F.col("attributes")))
        _model_document(ds, item, head, path, shards, lambda d: d)


def _two_sections(key: Column, first: Column, second: Column) -> list[tuple]:
    """Parts of an image: ``first`` in one section and the texts of the array ``second``, joined, in the next unless there are none."""
    return [(None, key, first), (F.size(second) > 0, key, F.array_join(second, ","))]


def _model_document(ds: AnnotationDataset, item: Column, image: Column, path: str, shards: int | None, info_of) -> None:
    """A document of lists of categories, images and annotations. Every shard lists all licences and the categories of its own boxes; each category is in one shard at least."""
    shards = shards or shards_for(ds)
    c = listed_categories(ds, shards).select("shard", F.col("id").alias("key"), _obj(id=F.col("id"), name=F.col("name"), supercategory=F.col("supercategory")).alias("part"))
    n = ds.licenses.agg(F.array_sort(F.collect_list(F.struct("id", _obj(id=F.col("id"), name=F.col("name"), url=F.col("url")).alias("j")))).alias("c")).first()["c"]
    import json

    info = json.dumps(info_of({k: v for k, v in ds.info.items() if v is not None and v != {}}))
    fixed_part = f'{{"info":{info},"licenses":[{",".join(x["j"] for x in n)}],"categories":['
    write_images(ds, path, shards, item, _two_sections(F.col("id"), image, F.col("items")), fixed_part, "]}", middles=('],"images":[', '],"annotations":['), missing="unknown", beside=c)


@register("coco", "one JSON document", "ids", "confidence", "supercategory", "area")
class Coco:
    SCHEMA = (
        "info struct<version:string,description:string,url:string,year:string,contributor:string,date_created:string>, licenses array<struct<id:bigint,name:string,url:string>>, "
        "images array<struct<id:bigint,file_name:string,width:bigint,height:bigint,license:bigint,date_captured:string>>, categories array<struct<id:bigint,name:string,supercategory:string>>, "
        "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int,score:double>>"
    )

    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        rows = json_sections(spark, path, "coco")
        images, categories, licenses, a = (_rows_of(rows, Coco.SCHEMA, x) for x in ("images", "categories", "licenses", "annotations"))
        b = from_xywh(*[F.get("bbox", i) for i in range(4)])
        kept = F.map_filter(F.create_map(F.lit("area"), F.format_string("%.6f", "area"), F.lit("iscrowd"), F.col("iscrowd").cast("string")), lambda k, v: v.isNotNull() & (v != "null"))
        a = a.select("id", "image_id", "category_id", *b.named(), F.col("score").alias("confidence"), kept.alias("attributes"), _ord("path", "_ord"))
        c = categories.groupBy("id", "name", "supercategory").agg(F.min(_ord("path", "_ord")).alias("_ord"))
        info = _info_of(rows, Coco.SCHEMA)
        if str(info.get("year", "")).isdigit():
            info["year"] = int(info["year"])
        return dataset(images.withColumnRenamed("license", "license_id").withColumn("_ord", _ord("path", "_ord")).drop("path"), c, a, licenses.drop("path", "_ord").distinct(), info)

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        b = box()
        at = lambda k: F.try_element_at("attributes", F.lit(k))
        area = F.coalesce(at("area").cast("double"), (b.xmax - b.xmin) * (b.ymax - b.ymin))
        item = _obj(id=F.col("id"), image_id=F.col("image_id"), category_id=F.col("category_id"), bbox=F.array(*_xywh().values()), area=area, iscrowd=F.coalesce(at("iscrowd").cast("int"), F.lit(0)), segmentation=F.array(), score=F.col("confidence"))
        head = _obj(id=F.col("id"), width=F.col("width"), height=F.col("height"), file_name=F.col("file_name"), license=F.col("license_id"), date_captured=F.col("date_captured"))
        _model_document(ds, item, head, path, shards, lambda d: {k: v for k, v in d.items() if k in INFO and k != "name"})


def _by_image(ds: AnnotationDataset, path: str, item: Column, head, missing: str | None = None, shards: int | None = None, bounds: str = "[]") -> None:
    """An array, or what else stands in ``bounds``, of one text for each image; ``head`` builds it from the image's columns and ``items``."""
    write_images(ds, path, shards or shards_for(ds), item, [(None, F.struct("file_name", "id"), head())], bounds[0], bounds[1], missing=missing)


def _with_list(ds: AnnotationDataset, c: DataFrame, entry: Column, item: Column, part: Column, path: str, shards: int, head: str, middle: str, tail: str, missing: str, order: str = "id", columns: tuple[str, ...] = ()) -> None:
    """Documents that begin with a list of categories, from rows with their ``shard``, and go on with the images."""
    first = c.select("shard", F.struct(F.lit("").alias("file_name"), F.col(order).cast("long").alias("id")).alias("key"), entry.alias("part"))
    write_images(ds, path, shards, item, [(None, F.struct("file_name", "id"), part)], head, tail, middles=(middle,), missing=missing, beside=first, columns=columns)


def _joined(fields: Column, **lists: Column) -> Column:
    """A JSON object's text with lists of JSON texts put in under their names."""
    out = F.regexp_replace(fields, r"\}$", "")
    for name, items in lists.items():
        out = F.concat(out, F.when(F.substring(out, -1, 1) == "{", "").otherwise(","), F.lit(f'"{name}":['), F.array_join(items, ","), F.lit("]"))
    return F.concat(out, F.lit("}"))


@register("create-ml", "JSON array, centres in pixels")
class CreateMl:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        parsed = _array_docs(spark, path, "create-ml", "image:string,annotations:array<struct<label:string,coordinates:struct<x:double,y:double,width:double,height:double>>>")
        rows = parsed.select("path", "at", F.col("d.image").alias("file_name"), "d.annotations")
        a = rows.select("path", "at", "file_name", F.posexplode("annotations").alias("k", "x")).withColumn("label", require(F.length("x.label") > 0, "a label is empty", F.col("x.label"))).withColumn("_ord", _ord("path", "at", "k"))
        a = annotations_of(a, from_cxcywh(*[F.col(f"x.coordinates.{k}") for k in ("x", "y", "width", "height")]))
        names = rows.select("file_name", F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))
        return from_raw(with_sizes(a, names, spark, images), a, parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        at = F.struct(*[c.alias(n) for c, n in zip(to_cxcywh(box()), ("x", "y", "width", "height"), strict=True)])
        _by_image(ds, path, _obj(label=F.col("label"), coordinates=at), lambda: _joined(_obj(image=F.col("file_name")), annotations=F.col("items")), "unknown", shards)


@register("bdd100k", "JSON array", "confidence")
class Bdd100k:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        parsed = _array_docs(spark, path, "bdd100k", "name:string,url:string,width:bigint,height:bigint,labels:array<struct<category:string,score:double,attributes:map<string,string>,box2d:struct<x1:double,y1:double,x2:double,y2:double>>>")
        rows = parsed.select("path", "at", F.coalesce("d.name", basename(F.col("d.url")), F.concat(F.lit("image_"), F.col("at").cast("string"))).alias("file_name"), "d.width", "d.height", "d.labels")
        a = rows.select("path", "at", "file_name", F.posexplode("labels").alias("k", "x")).where("x.box2d is not null").withColumns({"label": F.col("x.category"), "confidence": F.col("x.score"), "_ord": _ord("path", "at", "k")})
        a = a.withColumn("attributes", F.coalesce(F.transform_keys("x.attributes", lambda k, v: F.concat(F.lit("bdd100k_attribute_"), k)), F.create_map().cast("map<string,string>")))
        return from_raw(rows.select("file_name", "width", "height", F.struct("path", "at").alias("_ord")), annotations_of(a, Box(*[F.col(f"x.box2d.{k}") for k in ("x1", "y1", "x2", "y2")])), parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        item = _obj(category=F.col("label"), score=F.col("confidence"), box2d=F.struct(*[c.alias(n) for c, n in zip(box(), ("x1", "y1", "x2", "y2"), strict=True)]))
        _by_image(ds, path, item, lambda: _joined(_obj(name=F.col("file_name"), width=F.col("width"), height=F.col("height")), labels=F.col("items")), "object", shards)


@register("v7-darwin", "JSON array")
class V7Darwin:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        slot = "array<struct<slot_name:string,width:bigint,height:bigint,source_files:array<struct<file_name:string>>>>"
        rows = _parsed_docs(spark, path, "v7-darwin", f"item:struct<name:string,slots:{slot}>,annotations:array<struct<name:string,bounding_box:struct<x:double,y:double,w:double,h:double>>>")
        first = F.get("d.item.slots", F.lit(0))
        boxes = _boxes(F.col("d.annotations"), lambda x: x["bounding_box"].isNotNull(), "name", lambda x: from_xywh(*[x["bounding_box"][k] for k in "xywh"]))
        name = F.coalesce("d.item.name", F.get(first["source_files"], F.lit(0))["file_name"], F.concat(F.lit("image_"), F.col("at").cast("string")))
        return from_lists(rows.select("path", "at", name.alias("file_name"), first["width"].alias("width"), first["height"].alias("height"), boxes.alias("boxes")))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        item = F.struct(F.col("label").alias("name"), F.struct(*[c.alias(n) for c, n in zip(_xywh().values(), "xywh", strict=True)]).alias("bounding_box"))
        slot = F.array(F.struct(F.lit("0").alias("slot_name"), "width", "height", F.array(F.struct("file_name")).alias("source_files")))
        i = with_items(ds, item, "object", "width", "height").select("id", "file_name", _obj(item=F.struct(F.col("file_name").alias("name"), slot.alias("slots")), annotations=F.col("items")).alias("part"))
        write_documents(i.select(F.struct("file_name", "id").alias("key"), "part"), path, shards or shards_for(ds), "[", "]")


@register("label-studio", "JSON array, boxes in percent", "confidence")
class LabelStudio:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        result = "array<struct<type:string,score:double,original_width:bigint,original_height:bigint,value:struct<x:double,y:double,width:double,height:double,rotation:double,rectanglelabels:array<string>>>>"
        one = f"array<struct<score:double,result:{result}>>"
        parsed = _array_docs(spark, path, "label-studio", f"data:struct<image:string,width:bigint,height:bigint>,annotations:{one},completions:{one},predictions:{one}")
        human = F.coalesce("d.annotations", "d.completions")
        rows = parsed.select(
            "path", "at", basename(F.col("d.data.image")).alias("file_name"), F.col("d.data.width").alias("dw"), F.col("d.data.height").alias("dh"), human.alias("a"), F.col("d.predictions").alias("p")
        )
        rows = rows.withColumn("file_name", require((F.coalesce(F.size("a"), F.lit(0)) <= 1) & (F.coalesce(F.size("p"), F.lit(0)) <= 1), "a task has more than one set", F.col("file_name")))
        sets = rows.select("path", "at", "file_name", "dw", "dh", F.inline(F.array(F.struct(F.lit(0).alias("g"), F.get("a", F.lit(0)).alias("s")), F.struct(F.lit(1).alias("g"), F.get("p", F.lit(0)).alias("s")))))
        flat = sets.select("path", "at", "file_name", "dw", "dh", "g", F.col("s.score").alias("set_score"), F.posexplode("s.result").alias("k", "x"))
        w, h = F.coalesce("x.original_width", "dw"), F.coalesce("x.original_height", "dh")
        labels = F.col("x.value.rectanglelabels")
        flat = flat.withColumn("label", require((F.col("x.type") == "rectanglelabels") & (F.size(labels) == 1), "a result isn't a rectangle with one label", F.get(labels, F.lit(0))))
        flat = flat.withColumns({"w": w, "h": h, "confidence": F.when(F.col("g") == 1, F.coalesce("x.score", "set_score")), "_ord": _ord("file_name", "path", "at", "g", "k")})
        v = [F.col(f"x.value.{n}") for n in ("x", "y", "width", "height")]
        turn = F.coalesce("x.value.rotation", F.lit(0.0))
        flat_box = from_percent(*v, F.col("w"), F.col("h"))
        around = rotated_envelope(flat_box.xmin, flat_box.ymin, flat_box.xmax - flat_box.xmin, flat_box.ymax - flat_box.ymin, turn)
        flat = flat.withColumn("attributes", F.when(turn != 0, F.create_map(F.lit("ls_rotation_deg"), turn.cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
        found = Box(*[F.when(turn == 0, p).otherwise(q) for p, q in zip(flat_box, around, strict=True)])
        sizes = flat.groupBy("file_name").agg(F.max("w").alias("w"), F.max("h").alias("h"))
        i = rows.join(sizes, "file_name", "left").select("file_name", F.coalesce("w", "dw").alias("width"), F.coalesce("h", "dh").alias("height"))
        return from_raw(i, annotations_of(flat, found), parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        p = to_percent(box(), F.col("width").cast("double"), F.col("height").cast("double"))
        value = F.struct(*[c.alias(n) for c, n in zip(p, ("x", "y", "width", "height"), strict=True)], F.array("label").alias("rectanglelabels"))
        item = F.struct(F.col("confidence").isNotNull().alias("guess"), _obj(type=F.lit("rectanglelabels"), from_name=F.lit("label"), to_name=F.lit("image"), original_width=F.col("width"), original_height=F.col("height"), score=F.col("confidence"), value=value).alias("j"))

        def head() -> Column:
            some = lambda g: F.transform(F.filter("items", lambda x: x["guess"] == g), lambda x: x["j"])
            sets = lambda g: F.array(_joined(_obj(id=F.col("id")), result=some(g)))
            data = _obj(id=F.col("id"), data=F.struct(F.col("file_name").alias("image"), "width", "height"))
            return _joined(data, annotations=sets(False), predictions=F.when(F.size(some(True)) > 0, sets(True)).otherwise(F.array().cast("array<string>")))

        _by_image(ds, path, item, head, None, shards)


@register("scale-ai", "JSON array")
class ScaleAi:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        note = "array<struct<label:string,type:string,left:double,top:double,width:double,height:double,vertices:array<struct<x:double,y:double>>>>"
        parsed = _array_docs(spark, path, "scale-ai", f"task_id:string,params:struct<attachment:string,metadata:struct<width:bigint,height:bigint,filename:string>>,response:struct<annotations:{note}>")
        rows = parsed.select("path", "at", F.coalesce("d.params.metadata.filename", basename(F.col("d.params.attachment")), "d.task_id").alias("file_name"), F.col("d.params.metadata.width").alias("width"), F.col("d.params.metadata.height").alias("height"), "d.task_id", "d.params.attachment", F.col("d.response.annotations").alias("notes"))
        a = rows.select("path", "at", "file_name", F.posexplode("notes").alias("k", "x")).withColumns({"label": F.col("x.label"), "_ord": _ord("path", "at", "k")})
        shape = F.size("x.vertices") >= 3
        a = a.withColumn("attributes", _enveloped(shape, "scale_ai_enveloped"))
        a = a.where(require(F.coalesce(shape, F.lit(False)) | F.col("x.left").isNotNull(), "a geometry is neither a box nor a polygon", F.lit(True)))
        flat, around = from_xywh(F.col("x.left"), F.col("x.top"), F.col("x.width"), F.col("x.height")), envelope(F.col("x.vertices"))
        i = rows.select("file_name", "width", "height", F.map_filter(F.create_map(F.lit("scale_ai_task_id"), "task_id", F.lit("scale_ai_attachment"), "attachment"), lambda k, v: v.isNotNull()).alias("attributes"), F.struct("path", "at").alias("_ord"))
        return from_raw(i, annotations_of(a, Box(*[F.when(shape, q).otherwise(p) for p, q in zip(flat, around, strict=True)])), parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        v = _xywh()
        item = _obj(type=F.lit("box"), label=F.col("label"), left=v["x"], top=v["y"], width=v["width"], height=v["height"])
        at = lambda k, d: F.coalesce(F.try_element_at("attributes", F.lit(k)), d)

        def head() -> Column:
            params = F.struct(at("scale_ai_attachment", F.col("file_name")).alias("attachment"), F.struct("width", "height", F.col("file_name").alias("filename")).alias("metadata"))
            return F.concat(F.regexp_replace(_obj(task_id=at("scale_ai_task_id", F.concat(F.lit("task-"), F.col("id").cast("string"))), params=params), r"\}$", ""), F.lit(',"response":{"annotations":['), F.array_join("items", ","), F.lit("]}}"))

        _by_image(ds, path, item, head, "skip", shards)


@register("labelbox", "JSON lines")
class Labelbox:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        obj = "array<struct<name:string,bounding_box:struct<left:double,top:double,width:double,height:double>,polygon:array<struct<x:double,y:double>>>>"
        schema = f"data_row struct<id:string,external_id:string,row_data:string,global_key:string>, media_attributes struct<width:bigint,height:bigint>, projects map<string,struct<labels:array<struct<annotations:struct<objects:{obj}>>>>>"
        rows = json_lines(spark, path, "labelbox").select(F.from_json("line", schema).alias("d"), F.col("_ord").alias("at")).select("d.*", "at")
        # lines are checked and parsed once, for counts, boxes and images
        parsed = stored(rows)
        rows = parsed.withColumn("file_name", F.coalesce("data_row.external_id", basename(F.col("data_row.row_data")), "data_row.global_key"))
        a = rows.select("file_name", F.explode("projects").alias("project", "p")).select("file_name", "project", F.posexplode("p.labels").alias("n", "l")).select("file_name", "project", "n", F.posexplode("l.annotations.objects").alias("k", "x"))
        shape = F.coalesce(F.size("x.polygon") >= 3, F.lit(False))
        skipped = a.where(F.col("x.bounding_box").isNull() & ~shape).count()
        a = a.withColumn("attributes", _enveloped(F.col("x.bounding_box").isNull(), "labelbox_polygon_enveloped"))
        a = a.where(F.col("x.bounding_box").isNotNull() | shape).withColumns({"label": F.col("x.name"), "_ord": _ord("file_name", "project", "n", "k")})
        flat, around = from_xywh(*[F.col(f"x.bounding_box.{k}") for k in ("left", "top", "width", "height")]), envelope(F.col("x.polygon"))
        kept = F.create_map(F.lit("labelbox_data_row_id"), "data_row.id", F.lit("labelbox_row_data"), "data_row.row_data", F.lit("labelbox_global_key"), "data_row.global_key")
        i = rows.select("file_name", "media_attributes.width", "media_attributes.height", F.map_filter(kept, lambda k, v: v.isNotNull()).alias("attributes"), F.col("at").alias("_ord"))
        return from_raw(i, annotations_of(a, Box(*[F.when(F.col("x.bounding_box").isNotNull(), p).otherwise(q) for p, q in zip(flat, around, strict=True)])), info=_skipped("labelbox_skipped_objects", skipped), parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        v = _xywh()
        item = _obj(feature_id=F.concat(F.lit("feature-"), F.col("id").cast("string")), name=F.col("label"), bounding_box=F.struct(v["x"].alias("left"), v["y"].alias("top"), v["width"].alias("width"), v["height"].alias("height")))
        i = per_image(ds, item)
        at = lambda k, d: F.coalesce(F.try_element_at("attributes", F.lit(f"labelbox_{k}")), d)
        row = _obj(data_row=F.struct(at("data_row_id", F.concat(F.lit("row-"), F.col("id").cast("string"))).alias("id"), F.col("file_name").alias("external_id"), at("row_data", F.col("file_name")).alias("row_data")), media_attributes=F.struct("width", "height"))
        line = F.concat(F.regexp_replace(row, r"\}$", ""), F.lit(',"projects":{"project":{"labels":[{"annotations":{"objects":['), F.array_join("items", ","), F.lit("]}}]}}}"))
        write_lines(i.withColumn("line", line), path, "file_name", "id")


#: Classes without boxes that a line's class map takes.
_BARE_CLASSES = 1000


def _dealt(images: DataFrame, bare: DataFrame) -> DataFrame:
    """Rows (_line, members): ``bare`` (_class, member) dealt to few of the images by hash, so no line names many of them."""
    n = bare.count()
    lines_of = images.groupBy(F.pmod(F.xxhash64("id"), F.lit(-(-n // _BARE_CLASSES) + 1)).alias("_b")).agg(F.min("id").alias("_line"))
    lines_of = numbered(lines_of, "_line", name="_at", start=0) if n else lines_of.select("_line", F.lit(0).alias("_at"))
    found = max(1, lines_of.count()) if n else 1
    dealt = bare.withColumn("_to", F.pmod(F.xxhash64("_class"), F.lit(found))).join(lines_of, F.col("_to") == F.col("_at"))
    return dealt.groupBy("_line").agg(F.array_sort(F.collect_list("member")).alias("members"))


@register("sagemaker", "JSON lines", "confidence")
class Sagemaker:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        rows = json_lines(spark, path, "sagemaker").withColumn("m", F.from_json("line", "map<string,string>"))
        keys = F.filter(F.map_keys("m"), lambda k: F.map_contains_key("m", F.concat(k, F.lit("-metadata"))))
        rows = rows.withColumn("key", require(F.size(keys) == 1, "a line has no label attribute or several", F.get(keys, F.lit(0))))
        rows = rows.withColumn("source", F.element_at("m", F.lit("source-ref"))).withColumn("file_name", F.regexp_replace("source", "^s3://[^/]+/", ""))
        note = F.from_json(F.element_at("m", F.col("key")), "annotations array<struct<class_id:bigint,left:double,top:double,width:double,height:double>>, image_size array<struct<width:bigint,height:bigint,depth:bigint>>")
        meta = F.from_json(F.element_at("m", F.concat("key", F.lit("-metadata"))), "objects array<struct<confidence:double>>, `class-map` map<string,string>")
        # lines are checked and parsed once, for sizes and boxes
        rows = parsed = stored(rows.select("file_name", "source", note.alias("n"), meta.alias("t"), "_ord"))
        size = F.get("n.image_size", F.lit(0))
        i = rows.select("file_name", size["width"].alias("width"), size["height"].alias("height"), F.create_map(F.lit("sagemaker_source_ref"), "source").alias("attributes"), "_ord")
        a = rows.select("file_name", F.col("t.class-map").alias("names"), F.col("t.objects").alias("o"), F.posexplode("n.annotations").alias("k", "x"))
        a = a.withColumns({"label": F.coalesce(F.try_element_at("names", F.col("x.class_id").cast("string")), F.concat(F.lit("class_"), F.col("x.class_id").cast("string"))), "confidence": F.get("o", F.col("k"))["confidence"], "_ord": _ord("file_name", "k")})
        a = a.withColumn("label", require((F.col("x.width") >= 0) & (F.col("x.height") >= 0), "a box has a negative side", F.col("label")))
        return from_raw(i, annotations_of(a, from_xywh(F.col("x.left"), F.col("x.top"), F.col("x.width"), F.col("x.height"))), parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        """A line's class map names the classes of its boxes; classes without boxes are dealt to the maps of some lines."""
        c = numbered(ds.categories.select(F.col("id").alias("_k"), "name"), "_k", name="_class", start=0)
        numbered_ds = ds.changed(annotations=ds.annotations.join(c.select("_k", "_class"), F.col("category_id") == F.col("_k"), "left").drop("_k"))
        v = _xywh()
        member = lambda k, name: F.concat(F.lit('"'), k.cast("string"), F.lit('":'), _quoted(name))
        item = F.struct(
            "_class", v["x"].alias("left"), v["y"].alias("top"), v["width"].alias("width"), v["height"].alias("height"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
            member(F.col("_class"), F.col("label")).alias("member"),
        )
        i = per_image(numbered_ds, item)
        bare = c.join(ds.annotations.select(F.col("category_id").alias("_c")).distinct(), F.col("_k") == F.col("_c"), "left_anti")
        i = i.join(_dealt(ds.images, bare.select("_class", member(F.col("_class"), F.col("name")).alias("member"))), F.col("id") == F.col("_line"), "left")
        members = F.array_distinct(F.concat(F.transform("items", lambda x: x["member"]), F.coalesce("members", F.array().cast("array<string>"))))
        boxes = F.transform("items", lambda x: F.struct(x["_class"].alias("class_id"), x["left"].alias("left"), x["top"].alias("top"), x["width"].alias("width"), x["height"].alias("height")))
        label = F.to_json(F.struct(F.array(F.struct("width", "height", F.lit(3).alias("depth"))).alias("image_size"), boxes.alias("annotations")))
        objects = F.to_json(F.transform("items", lambda x: F.struct(x["confidence"].alias("confidence"))))
        rest = F.concat(F.lit(',"type":"groundtruth/object-detection","human-annotated":"yes","class-map":{'), F.array_join(members, ","), F.lit("}}}"))
        ref = F.to_json(F.struct(F.coalesce(F.try_element_at("attributes", F.lit("sagemaker_source_ref")), F.col("file_name")).alias("source-ref")))
        line = F.concat(F.regexp_replace(ref, r"\}$", ""), F.lit(',"bounding-box":'), label, F.lit(',"bounding-box-metadata":{"objects":'), objects, rest)
        write_lines(i.withColumn("line", line), path, "file_name", "id")


#: Names of splits in paths of Parquet files.
SPLIT_NAMES = {"train": "train", "test": "test", "validation": "validation", "valid": "validation", "val": "validation", "dev": "dev"}


def _split_of(path: Column) -> Column:
    """The split of a Parquet file: by its name up to a dash, else by the nearest folder that names one."""
    known = F.create_map(*[F.lit(x) for pair in SPLIT_NAMES.items() for x in pair])
    parts = F.reverse(F.split(F.lower(path), "/"))
    name = F.get(parts, F.lit(0))
    by_folder = F.transform(F.slice(parts, 2, 1 << 10), lambda p: F.try_element_at(known, p))
    own = F.try_element_at(known, F.regexp_extract(name, r"^([a-z]+)(-.*|\.parquet)$", 1))
    return F.coalesce(own, F.get(F.filter(by_folder, lambda s: s.isNotNull()), F.lit(0)))


@register("hf", "JSON lines (metadata.jsonl), or Parquet for reading")
class HfImageFolder:
    SCHEMA = "file_name string, width bigint, height bigint, objects struct<bbox:array<array<double>>,categories:array<string>,category:array<string>>"

    @staticmethod
    def _rows(rows: DataFrame, corners: bool) -> AnnotationDataset:
        names = F.coalesce("objects.categories", "objects.category")
        rows = rows.withColumn("file_name", require(F.coalesce(F.size("objects.bbox"), F.lit(0)) == F.coalesce(F.size(names), F.lit(0)), "boxes and categories differ in number", F.col("file_name")))
        a = rows.select("file_name", F.col("_ord").alias("at"), F.posexplode(F.arrays_zip(F.col("objects.bbox").alias("b"), names.alias("c"))).alias("k", "x")).withColumns({"label": F.col("x.c"), "_ord": F.struct("file_name", "at", "k")})
        four = [F.get("x.b", F.lit(i)) for i in range(4)]
        return from_raw(rows.select("file_name", "width", "height", "_ord"), annotations_of(a, Box(*four) if corners else from_xywh(*four)), info={"attributes": {"hf_bbox_format": "xyxy" if corners else "xywh"}})

    @staticmethod
    def read(spark: SparkSession, path: str, corners: bool = False, parquet: bool = False, split: str | None = None) -> AnnotationDataset:
        """Metadata as lines or, with ``parquet``, as Parquet files.

        ``split`` reads one split: a folder with its own metadata.jsonl or, of Parquet files, those
        whose name or folder says so (val, valid and validation are one). Without it all are read.
        """
        if parquet:
            p = spark.read.option("recursiveFileLookup", "true").parquet(path)
            if split is not None:
                p = p.where(_split_of(relative(F.col("_metadata.file_path"), path)) == SPLIT_NAMES.get(split.lower(), split))
                if p.isEmpty():
                    raise ValueError(f"no Parquet files of split {split!r} here")
            rows = p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("long").alias(c) for c in ("file_name", "width", "height")], "objects", F.lit(0).alias("_ord"))
            fields = rows.schema["objects"].dataType.names
            have = lambda n: F.col(f"objects.{n}").cast("array<string>").alias(n) if n in fields else F.lit(None).cast("array<string>").alias(n)
            return HfImageFolder._rows(rows.withColumn("objects", F.struct(F.col("objects.bbox").cast("array<array<double>>").alias("bbox"), have("categories"), have("category"))), corners)
        if split is not None:
            if exists(spark, f"{path}/metadata.jsonl"):
                raise ValueError(f"no split {split!r} here: metadata.jsonl stands at the root")
            path = f"{path}/{split}/metadata.jsonl"
            if not exists(spark, path):
                raise ValueError(f"no split {split!r} with metadata.jsonl here")
        elif exists(spark, f"{path}/metadata.jsonl"):
            path = f"{path}/metadata.jsonl"
        in_splits = split is None and bool(paths_like(spark, f"{path}/*/metadata.jsonl"))
        rows = json_lines(spark, path, "hf", "metadata.jsonl" if in_splits else "*").select(F.from_json("line", HfImageFolder.SCHEMA).alias("d"), "_ord").select("d.*", "_ord")
        return HfImageFolder._rows(rows, corners)

    @staticmethod
    def write(ds: AnnotationDataset, path: str, corners: bool = False) -> None:
        b = box()
        item = F.struct(F.array(*(b if corners else _xywh().values())).alias("b"), F.col("label").alias("c"))
        i = per_image(ds, item)
        objects = F.struct(F.transform("items", lambda x: x["b"]).alias("bbox"), F.transform("items", lambda x: x["c"]).alias("categories"))
        write_lines(i.withColumn("line", F.to_json(F.struct("file_name", "width", "height", objects.alias("objects")))), path, "file_name", "id")


@register("ibm-cloud-annotations", "one JSON document, boxes as shares")
class CloudAnnotations:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        docs = json_documents(spark, path, "ibm-cloud-annotations").select("path", F.from_json("text", "type string, labels array<string>, annotations map<string,array<struct<x:double,y:double,x2:double,y2:double,label:string>>>").alias("d")).select("path", "d.*")
        docs = docs.withColumn("annotations", require(F.col("type") == "localization", "the document isn't of type localization", F.col("annotations")))
        rows = docs.select("path", F.explode("annotations").alias("file_name", "list"))
        names = rows.select("file_name", F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")).distinct()
        a = rows.select("file_name", F.posexplode("list").alias("k", "x")).withColumns({"label": F.col("x.label"), "_ord": _ord("file_name", "k")})
        sizes = with_sizes(a, names, spark, images)
        if images is None:
            raise ValueError("boxes are shares of the image: say where the images are")
        sized = a.join(sizes.select(F.col("file_name").alias("_f"), "width", "height"), F.col("file_name") == F.col("_f"))
        return from_raw(sizes, annotations_of(sized, to_pixel(Box(*[F.col(f"x.{k}") for k in ("x", "y", "x2", "y2")]), F.col("width"), F.col("height"))), docs.select(F.explode("labels").alias("name")))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        n = to_normalized(box(), F.col("width").cast("double"), F.col("height").cast("double"))
        item = _obj(x=n.xmin, y=n.ymin, x2=n.xmax, y2=n.ymax, label=F.col("label"))
        part = F.concat(_quoted(F.col("file_name")), F.lit(":["), F.array_join("items", ","), F.lit("]"))
        shards = shards or shards_for(ds)
        _with_list(ds, listed_names(ds, shards, "name"), _quoted(F.col("name")), item, part, path, shards, '{"version":"1.0","type":"localization","labels":[', '],"annotations":{', "}}", "skip")


@register("datumaro", "one JSON document")
class Datumaro:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        schema = "categories struct<label:struct<labels:array<struct<name:string,parent:string>>>>, items array<struct<id:string,image:struct<path:string,size:array<bigint>>,annotations:array<struct<type:string,label_id:int,bbox:array<double>>>>>"
        # documents are parsed once; labels are looked up by document and place, so no row carries its document's list
        docs = json_documents(spark, path, "datumaro").select("path", F.from_json("text", schema).alias("d"))
        listed = stored(docs.select("path", F.posexplode("d.categories.label.labels").alias("n", "l")).select("path", "n", "l.name", "l.parent"))
        found = stored(docs.select("path", F.posexplode("d.items").alias("at", "i")))
        rows = found.withColumn("file_name", F.coalesce("i.image.path", "i.id"))
        size = lambda k: F.coalesce(F.get("i.image.size", F.lit(k)), F.lit(1))
        a = rows.select("path", "at", "file_name", F.posexplode("i.annotations").alias("k", "x")).where("x.type = 'bbox'")
        a = a.join(listed.select(F.col("path").alias("_p"), "n", "name").hint("merge"), (F.col("path") == F.col("_p")) & (F.col("x.label_id") == F.col("n")), "left")
        a = a.withColumns({"label": F.coalesce("name", F.concat(F.lit("label_"), F.col("x.label_id").cast("string"))), "_ord": _ord("path", "at", "k")})
        c = listed.select("name", F.nullif(F.col("parent"), F.lit("")).alias("supercategory"))
        return from_raw(rows.select("file_name", size(1).alias("width"), size(0).alias("height"), F.struct("path", "at").alias("_ord")), annotations_of(a, from_xywh(*[F.get("x.bbox", F.lit(i)) for i in range(4)])), c, parsed=(listed, found))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        """A document lists the different categories of its own boxes, and each category is in one document at least; ``label_id`` is the place in that list."""
        n = shards or shards_for(ds)
        names = ("name", "supercategory")
        # a document's list is no longer than the document; what its boxes name comes first, in the order of their places
        c = listed_names(ds, n, *names).withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("bare", *names)) - 1)
        item = _obj(id=F.col("id"), type=F.lit("bbox"), label_id=F.col("_place"), bbox=F.array(*_xywh().values()))
        head = _joined(_obj(id=stem(F.col("file_name")), image=F.struct(F.col("file_name").alias("path"), F.array("height", "width").alias("size"))), annotations=F.col("items"))
        label = _obj(name=F.col("name"), parent=F.coalesce("supercategory", F.lit("")))
        _with_list(ds, c, label, item, head, path, n, '{"info":{},"categories":{"label":{"labels":[', ']}},"items":[', "]}", "object", "place", names[1:])


@register("edge-impulse", "one JSON document")
class EdgeImpulse:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        b = "array<struct<label:string,x:double,y:double,width:double,height:double>>"
        docs = json_documents(spark, path, "edge-impulse").select("path", F.from_json("text", f"files array<struct<path:string,boundingBoxes:{b}>>, boundingBoxes map<string,{b}>").alias("d"))
        entries = F.transform(F.map_entries("d.boundingBoxes"), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("boundingBoxes")))
        none = F.array().cast(f"array<struct<path:string,boundingBoxes:{b}>>")
        rows = docs.select("path", F.posexplode(F.concat(F.coalesce("d.files", none), F.coalesce(entries, none))).alias("at", "d"))
        whole = lambda x: reduce(and_, [x[k].isNotNull() for k in ("label", "x", "y", "width", "height")])
        boxes = _boxes(F.col("d.boundingBoxes"), whole, "label", lambda x: from_xywh(*[x[k] for k in ("x", "y", "width", "height")]))
        rows = rows.select("path", "at", F.col("d.path").alias("file_name"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), boxes.alias("boxes"))
        return from_lists(with_sizes(rows, rows, spark, images), by_name=True)

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        i = with_items(ds, F.struct("label", *[c.alias(n) for n, c in _xywh().items()]), "object")
        part = _obj(path=F.col("file_name"), category=F.lit("training"), boundingBoxes=F.col("items"))
        write_documents(i.select(F.struct("file_name", "id").alias("key"), part.alias("part")), path, shards or shards_for(ds), '{"version":1,"files":[', "]}")


@register("via", "one JSON document")
class Via:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        region = "struct<shape_attributes:struct<name:string,x:double,y:double,width:double,height:double>,region_attributes:map<string,string>>"
        docs = json_documents(spark, path, "via").select("path", F.explode(F.from_json("text", f"map<string,struct<filename:string,size:bigint,regions:array<{region}>,file_attributes:map<string,string>>>")).alias("key", "v"))
        rows = parsed = stored(docs.select("path", "key", F.col("v.filename").alias("file_name"), "v.size", "v.regions", "v.file_attributes"))
        a = rows.select("key", "file_name", F.posexplode("regions").alias("k", "x")).where("x.shape_attributes.name = 'rect'")
        named = F.map_filter("x.region_attributes", lambda k, v: v.isNotNull() & (F.btrim(v) != ""))
        has = lambda k: F.coalesce(F.map_contains_key(named, k), F.lit(False))
        said = F.when(has("label"), "label").when(has("class"), "class").when(F.size(named) == 1, F.get(F.map_keys(named), F.lit(0)))
        a = a.withColumn("said", said).where("said is not null")
        others = prefixed(F.map_filter("x.region_attributes", lambda k, v: k != F.col("said")), "via_region_attr_")
        a = a.withColumns({"label": F.try_element_at(named, F.col("said")), "attributes": others, "_ord": _ord("file_name", "key", "k")})
        a = annotations_of(a, from_xywh(*[F.col(f"x.shape_attributes.{k}") for k in ("x", "y", "width", "height")]))
        names = rows.select("file_name", F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.map_concat(prefixed(F.create_map(F.lit("size_bytes"), F.col("size").cast("string")), "via_"), prefixed(F.col("file_attributes"), "via_file_attr_")).alias("attributes"))
        return from_raw(with_sizes(a, names, spark, images), a, parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        item = _obj(shape_attributes=F.struct(F.lit("rect").alias("name"), *[c.alias(n) for n, c in _xywh().items()]), region_attributes=F.map_concat(F.create_map(F.lit("label"), F.col("label")), F.map_filter(carried("via_region_attr_"), lambda k, v: k != "label")))
        size = F.coalesce(F.try_element_at("attributes", F.lit("via_size_bytes")).cast("long"), F.lit(0))
        head = _joined(_obj(filename=F.col("file_name"), size=size, file_attributes=carried("via_file_attr_")), regions=F.col("items"))
        key = F.to_json(F.array(F.concat("file_name", size.cast("string"))))
        _by_image(ds, path, item, lambda: F.concat(key.substr(F.lit(2), F.length(key) - 2), F.lit(":"), head), "unknown", shards, "{}")


@register("vott-json", "one JSON document")
class VottJson:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        region = "struct<tags:array<string>,boundingBox:struct<left:double,top:double,width:double,height:double>,points:array<struct<x:double,y:double>>>"
        docs = json_documents(spark, path, "vott-json").select("path", F.from_json("text", f"tags array<struct<name:string>>, assets map<string,struct<asset:struct<name:string,path:string,size:struct<width:bigint,height:bigint>>,regions:array<{region}>>>").alias("d")).select("path", "d.*")
        parsed = stored(docs.select("path", F.explode("assets").alias("key", "v")))
        rows = parsed.select("key", F.coalesce("v.asset.name", basename(F.col("v.asset.path"))).alias("file_name"), "v.asset.size.width", "v.asset.size.height", "v.regions")
        a = rows.select("file_name", "key", F.posexplode("regions").alias("k", "x")).select("file_name", "key", "k", "x", F.posexplode("x.tags").alias("t", "label")).withColumn("_ord", _ord("file_name", "key", "k", "t"))
        flat, around = from_xywh(*[F.col(f"x.boundingBox.{k}") for k in ("left", "top", "width", "height")]), envelope(F.col("x.points"))
        found = Box(*[F.when(F.col("x.boundingBox").isNotNull(), p).otherwise(q) for p, q in zip(flat, around, strict=True)])
        return from_raw(rows.select("file_name", "width", "height", F.col("key").alias("_ord")), annotations_of(a, found), docs.select(F.explode("tags").alias("t")).select(F.col("t.name").alias("name")), parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        """A document's tags are the names of its own boxes' categories; each name is in one document at least."""
        b, v = box(), _xywh()
        corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        points = F.array(corner(b.xmin, b.ymin), corner(b.xmax, b.ymin), corner(b.xmax, b.ymax), corner(b.xmin, b.ymax))
        item = _obj(id=F.concat(F.lit("region-"), F.col("id").cast("string")), type=F.lit("RECTANGLE"), tags=F.array("label"), boundingBox=F.struct(v["x"].alias("left"), v["y"].alias("top"), v["width"].alias("width"), v["height"].alias("height")), points=points)
        head = _joined(_obj(asset=F.struct(F.col("id").cast("string").alias("id"), F.col("file_name").alias("name"), F.struct("width", "height").alias("size"))), regions=F.col("items"))
        part = F.concat(F.lit('"asset-'), F.col("id").cast("string"), F.lit('":'), head)
        n = shards or shards_for(ds)
        _with_list(ds, listed_names(ds, n, "name"), _obj(name=F.col("name")), item, part, path, n, '{"name":"dataset","version":"2.2.0","tags":[', '],"assets":{', "}}", "skip")


@register("openlabel", "one JSON document, centres in pixels")
class OpenLabel:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        frame = "struct<frame_properties:struct<file_name:string,width:bigint,height:bigint>,objects:map<string,struct<object_data:struct<bbox:array<struct<name:string,val:array<double>>>>>>>"
        docs = json_documents(spark, path, "openlabel").select("path", F.from_json("text", f"openlabel struct<objects:map<string,struct<name:string,type:string>>,frames:map<string,{frame}>>").alias("d"))
        # documents are parsed once; types are looked up by document and key, so no row carries its document's objects
        types = stored(docs.select("path", F.explode("d.openlabel.objects").alias("o", "t")).select(F.col("path").alias("_p"), F.col("o").alias("_o"), F.col("t.type").alias("type")))
        found = stored(docs.select("path", F.explode("d.openlabel.frames").alias("at", "f")))
        rows = found.withColumn("file_name", F.coalesce("f.frame_properties.file_name", F.concat(F.lit("frame_"), "at")))
        a = rows.select("path", "at", "file_name", F.explode("f.objects").alias("o", "v")).select("path", "at", "file_name", "o", F.posexplode("v.object_data.bbox").alias("k", "x"))
        a = a.where((F.size("x.val") >= 4) & (F.coalesce(F.get("x.val", F.lit(4)), F.lit(0.0)) == 0.0))
        # as many as boxes, though their files are small: never broadcast
        a = a.join(types.hint("merge"), (F.col("path") == F.col("_p")) & (F.col("o") == F.col("_o")), "left")
        a = a.withColumns({"label": F.coalesce("type", "x.name", F.lit("object")), "_ord": _ord("path", "at", "o", "k")})
        return from_raw(rows.select("file_name", "f.frame_properties.width", "f.frame_properties.height", F.struct("path", "at").alias("_ord")), annotations_of(a, from_cxcywh(*[F.get("x.val", F.lit(i)) for i in range(4)])), parsed=(types, found))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        # objects are named by image and place: annotation ids may repeat, and equal names would hide one another
        shape = _obj(object_data=F.struct(F.array(F.struct(F.lit("shape").alias("name"), F.array(*to_cxcywh(box())).alias("val"))).alias("bbox")))
        types = _obj(name=F.concat(F.lit("object-"), F.col("id").cast("string")), type=F.col("label"))
        keyed = lambda items: F.transform(items, lambda x, n: F.concat(F.lit('"'), F.col("id").cast("string"), F.lit("_"), n.cast("string"), F.lit('":'), x))
        head = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('":'), F.regexp_replace(_obj(frame_properties=F.struct("file_name", "width", "height")), r"\}$", ""), F.lit(',"objects":{'), F.array_join(keyed("items"), ","), F.lit("}}"))
        parts = _two_sections(F.col("id"), head, keyed("types"))
        write_images(ds, path, shards or shards_for(ds), shape, parts, '{"openlabel":{"metadata":{"schema_version":"1.0.0"},"frames":{', "}}}", middles=('},"objects":{',), missing="object", types=types)


@register("unity-perception", "JSON documents with captures")
class UnityPerception:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        value = "struct<instanceId:bigint,labelId:bigint,labelName:string,label_id:bigint,label_name:string,origin:array<double>,dimension:array<double>,x:double,y:double,width:double,height:double>"
        named = "sequence_id:string,sequenceId:string,sequence:string,step:string,frame:string,timestamp:string"
        schema = f"{named.replace(':', ' ')}, captures array<struct<id:string,capture_id:string,captureId:string,sensor_id:string,sensorId:string,{named},filename:string,dimension:array<double>,annotations:array<struct<`@type`:string,values:array<{value}>>>>>"
        docs = json_documents(spark, path, "unity-perception", "*.json").select("path", F.from_json("text", schema).alias("d")).select("path", "d", F.posexplode("d.captures").alias("at", "c"))
        either = lambda *names: F.coalesce(*[F.col(f"{at}.{n}") for at in ("d", "c") for n in names])
        facts = {"capture_id": F.coalesce("c.id", "c.capture_id", "c.captureId"), "sequence_id": either("sequence_id", "sequenceId"), **{k: either(k) for k in ("sequence", "step", "frame", "timestamp")}, "sensor_id": F.coalesce("c.sensor_id", "c.sensorId", "c.id")}
        kept = prefixed(F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]), "unity_perception_")
        rows = docs.withColumn("file_name", F.col("c.filename")).withColumn("attributes", kept)
        size = lambda k: F.round(F.get("c.dimension", F.lit(k))).cast("long")
        blocks = rows.select("path", "at", "file_name", F.posexplode("c.annotations").alias("n", "b"))
        boxes = F.coalesce(F.lower("b.@type").contains("box2d") | F.lower("b.@type").contains("boundingbox2d"), F.lit(False))
        skipped = blocks.where(~boxes).count()
        a = blocks.where(boxes)
        a = a.select("file_name", "path", "at", "n", F.posexplode("b.values").alias("k", "x"))
        a = a.withColumns({"label": F.coalesce("x.labelName", "x.label_name", F.concat(F.lit("label_"), F.coalesce("x.labelId", "x.label_id").cast("string"))), "_ord": _ord("file_name", "path", "at", "n", "k")})
        part = lambda name, array, k: F.coalesce(F.col(f"x.{name}"), F.get(f"x.{array}", F.lit(k)))
        return from_raw(rows.select("file_name", size(0).alias("width"), size(1).alias("height"), "attributes", F.struct("path", "at").alias("_ord")), annotations_of(a, from_xywh(part("x", "origin", 0), part("y", "origin", 1), part("width", "dimension", 0), part("height", "dimension", 1))), info=_skipped("unity_perception_skipped_annotations", skipped))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        from .common import write_files

        v = _xywh()
        item = F.to_json(F.struct(F.col("id").alias("instanceId"), F.col("category_id").alias("labelId"), F.col("label").alias("labelName"), F.array(v["x"], v["y"]).alias("origin"), F.array(v["width"], v["height"]).alias("dimension")))
        i = per_image(ds, item)
        said = lambda k, default: attribute(f"unity_perception_{k}", default)
        # numbers stand as numbers, all else as text
        plain = lambda c: F.when(F.rlike(c, F.lit(r"^-?(0|[1-9]\d*)(\.\d+)?$")), c).otherwise(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
        number_of = F.col("id").cast("string")
        capture = F.concat(F.regexp_replace(_obj(id=said("capture_id", said("sensor_id", "camera")), sensor_id=said("sensor_id", "camera"), sequence_id=said("sequence_id", None), filename=F.col("file_name"), dimension=F.array("width", "height")), r"\}$", ""), F.lit(',"annotations":[{"@type":"type.unity.com/unity.solo.BoundingBox2DAnnotation","id":"bounding box","values":['), F.array_join("items", ","), F.lit("]}]}"))
        text = F.concat(F.lit('{"frame":'), plain(said("frame", number_of)), F.lit(',"sequence":'), plain(said("sequence", "0")), F.lit(',"step":'), plain(said("step", number_of)), F.lit(',"timestamp":'), plain(said("timestamp", number_of)), F.lit(',"captures":['), capture, F.lit("]}"))
        write_files(i.select(F.concat(F.lit("sequence.0/step"), F.col("id").cast("string"), F.lit(".frame_data.json")).alias("name"), text.alias("content")), path)
