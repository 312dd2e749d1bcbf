"""Formats of one line for each box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, box, from_xywh, to_normalized, to_pixel
from tessera.model import AnnotationDataset
from tessera.storage import stored

from .common import annotations_of, basename, csv_cell, from_raw, lines, number, per_image, per_row, register, require, write_lines
from .pictures import with_sizes


def _cells(spark: SparkSession, path: str, names: str, first: str) -> DataFrame:
    """Lines split into named text columns; header and blank lines are left out."""
    schema = ", ".join(f"{n} string" for n in names.split())
    rows = _parsed(spark, path, schema)
    return stored(rows.where(F.coalesce(F.lower(names.split()[0]), F.lit("")) != first.lower()))


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't blank as columns; each is parsed once, however many columns are asked for."""
    return lines(spark, path).where(F.btrim("line") != "").select("_ord", F.inline(F.array(F.from_csv("line", schema, {"escape": '"'}))))


def _line(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(F.coalesce(c, F.lit(""))) for c in cells])


def _f(name: str) -> Column:
    return F.col(name).cast("double")


def _same_size(rows: DataFrame) -> DataFrame:
    """Images with their size; one file with two sizes is an error."""
    i = rows.groupBy("file_name").agg(F.min(F.struct("w", "h")).alias("lo"), F.max(F.struct("w", "h")).alias("hi"))
    return i.select("file_name", require(F.col("lo") == F.col("hi"), F.concat(F.lit("different sizes for "), F.col("file_name")), F.col("lo.w")).cast("long").alias("width"), F.col("lo.h").cast("long").alias("height"))


def _detection_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells as they are stored, and rows that read them."""
    cells = _cells(spark, path, "filename w h label xmin ymin xmax ymax", "filename")
    return cells, cells.withColumnRenamed("filename", "file_name").withColumns({c: _f(c) for c in ("w", "h", "xmin", "ymin", "xmax", "ymax")})


_HEADER = "filename,width,height,class,xmin,ymin,xmax,ymax"


@register("tfod", "headed CSV, boxes as shares")
class Tfod:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        parsed, rows = _detection_rows(spark, path)
        return from_raw(_same_size(rows), annotations_of(rows, to_pixel(box(), F.col("w"), F.col("h"))), parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        n = to_normalized(box(), F.col("width").cast("double"), F.col("height").cast("double"))
        write_lines(per_row(ds).withColumn("line", _line(F.col("file_name"), F.col("width").cast("string"), F.col("height").cast("string"), F.col("label"), *map(number, n))), path, "id", header=_HEADER)


@register("udacity", "headed CSV, boxes in pixels")
class Udacity:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        parsed, rows = _detection_rows(spark, path)
        return from_raw(_same_size(rows), annotations_of(rows, box()), parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        write_lines(per_row(ds).withColumn("line", _line(F.col("file_name"), F.col("width").cast("string"), F.col("height").cast("string"), F.col("label"), *map(number, box()))), path, "id", header=_HEADER)


@register("vott-csv", "headed CSV")
class VottCsv:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        rows = _cells(spark, path, "file_name xmin ymin xmax ymax label", "image").withColumns({c: _f(c) for c in ("xmin", "ymin", "xmax", "ymax")})
        a = annotations_of(rows, box()).withColumn("_ord", F.struct("file_name", "label", "xmin", "ymin", "xmax", "ymax", "_ord"))
        return from_raw(with_sizes(a, None, spark, images), a)

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        write_lines(per_row(ds).withColumn("line", _line(F.col("file_name"), *map(number, box()), F.col("label"))), path, "file_name", "id", header="image,xmin,ymin,xmax,ymax,label")


@register("retinanet", "CSV without a header")
class Retinanet:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        rows = _cells(spark, path, "file_name x1 y1 x2 y2 label", "path")
        blank = F.coalesce(F.concat("x1", "y1", "x2", "y2", "label"), F.lit("")) == ""
        full = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull() & F.col("label").isNotNull()
        some = F.coalesce("x1", "y1", "x2", "y2", "label").isNotNull()
        rows = rows.withColumn("file_name", require(full | ~some, "a row has only part of a box", F.col("file_name")))
        a = annotations_of(rows.where(~blank), Box(_f("x1"), _f("y1"), _f("x2"), _f("y2")))
        names = rows.select("file_name", F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")).distinct()
        return from_raw(with_sizes(a, names, spark, images), a)

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        rows = per_row(ds).select("file_name", "id", _line(F.col("file_name"), *map(number, box()), F.col("label")).alias("line"))
        bare = ds.images.join(ds.annotations.select("image_id").distinct(), F.col("id") == F.col("image_id"), "left_anti")
        write_lines(rows.union(bare.select("file_name", "id", F.concat(csv_cell(F.col("file_name")), F.lit(",,,,,")).alias("line"))), path, "file_name", "id")


@register("openimages", "headed CSV, boxes as shares, minima and maxima of x before y", "confidence")
class OpenImages:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        rows = _cells(spark, path, "image source label confidence x1 x2 y1 y2", "imageid").withColumn("file_name", F.when(F.rlike("image", F.lit(r"\.[A-Za-z0-9]+$")), F.col("image")).otherwise(F.concat("image", F.lit(".jpg"))))
        rows = rows.withColumn("confidence", _f("confidence")).withColumn("attributes", F.create_map(F.lit("openimages_source"), F.coalesce("source", F.lit(""))))
        sizes = with_sizes(rows, None, spark, images, guessed=True)
        if sizes is None:
            raise ValueError("boxes are shares of the image: say where the images are")
        sized = rows.join(sizes.select(F.col("file_name").alias("_f"), "width", "height"), F.col("file_name") == F.col("_f"))
        return from_raw(sizes, annotations_of(sized, to_pixel(Box(_f("x1"), _f("y1"), _f("x2"), _f("y2")), F.col("width"), F.col("height"))))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        n = to_normalized(box(), F.col("width").cast("double"), F.col("height").cast("double"))
        source = F.coalesce(F.try_element_at("attributes", F.lit("openimages_source")), F.lit("xclick"))
        line = _line(F.col("file_name"), source, F.col("label"), number(F.coalesce("confidence", F.lit(1.0))), number(n.xmin), number(n.xmax), number(n.ymin), number(n.ymax))
        write_lines(per_row(ds).withColumn("line", line), path, "id", header="ImageID,Source,LabelName,Confidence,XMin,XMax,YMin,YMax")


@register("kaggle-wheat", "headed CSV, one class")
class KaggleWheat:
    @staticmethod
    def read(spark: SparkSession, path: str) -> AnnotationDataset:
        rows = _cells(spark, path, "file_name w h bbox source", "image_id").withColumns({"w": _f("w"), "h": _f("h")})
        rows = rows.withColumn("b", F.transform(F.split(F.regexp_replace("bbox", r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))).withColumn("label", F.lit("wheat_head"))
        i = _same_size(rows).join(rows.groupBy("file_name").agg(F.min_by("source", "_ord").alias("s")), "file_name")
        i = i.withColumn("attributes", F.map_filter(F.create_map(F.lit("kaggle_wheat_source"), "s"), lambda k, v: v.isNotNull())).drop("s")
        only = spark.range(1).select(F.lit("wheat_head").alias("name"))
        return from_raw(i, annotations_of(rows, from_xywh(*[F.get("b", k) for k in range(4)])), only)

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        b = box()
        text = F.concat(F.lit("["), F.concat_ws(", ", number(b.xmin), number(b.ymin), number(b.xmax - b.xmin), number(b.ymax - b.ymin)), F.lit("]"))
        source = F.try_element_at("image_attributes", F.lit("kaggle_wheat_source"))
        write_lines(per_row(ds, "wheat_head").withColumn("line", _line(F.col("file_name"), F.col("width").cast("string"), F.col("height").cast("string"), text, source)), path, "id", header="image_id,width,height,bbox,source")


@register("automl-vision", "CSV without a header, eleven columns, boxes as shares")
class AutomlVision:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        rows = _cells(spark, path, "ml_use uri label x1 y1 p q x2 y2 r s", "set").withColumn("file_name", F.regexp_replace("uri", "^gs://[^/]+/", ""))
        # nine columns have no gaps: the corners stand next to each other
        rows = rows.withColumn("x2", F.coalesce("x2", F.col("p"))).withColumn("y2", F.coalesce("y2", F.col("q")))
        first = rows.groupBy("file_name").agg(F.min_by(F.struct("ml_use", "uri"), "_ord").alias("m"))
        i = first.select("file_name", F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.create_map(F.lit("automl_ml_use"), F.coalesce("m.ml_use", F.lit("UNASSIGNED")), F.lit("automl_uri"), F.col("m.uri")).alias("attributes"))
        sizes = with_sizes(rows, i, spark, images, F.when(F.startswith(F.try_element_at("attributes", F.lit("automl_uri")), F.lit("gs://")), basename(F.col("file_name"))))
        if images is None:
            raise ValueError("boxes are shares of the image: say where the images are")
        sized = rows.join(sizes.select(F.col("file_name").alias("_f"), "width", "height"), F.col("file_name") == F.col("_f")).where("x1 is not null")
        return from_raw(sizes, annotations_of(sized, to_pixel(Box(_f("x1"), _f("y1"), _f("x2"), _f("y2")), F.col("width"), F.col("height"))))

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        n = to_normalized(box(), F.col("width").cast("double"), F.col("height").cast("double"))
        at = lambda k, d: F.coalesce(F.try_element_at("image_attributes", F.lit(k)), d)
        none = F.lit("")
        line = _line(at("automl_ml_use", F.lit("UNASSIGNED")), at("automl_uri", F.col("file_name")), F.col("label"), number(n.xmin), number(n.ymin), none, none, number(n.xmax), number(n.ymax), none, none)
        write_lines(per_row(ds).withColumn("line", line), path, "id")


@register("via-csv", "headed CSV with JSON cells")
class ViaCsv:
    @staticmethod
    def read(spark: SparkSession, path: str, images: str | None = None) -> AnnotationDataset:
        schema = "file_name string, size string, file_attributes string, n string, i string, shape string, region string"
        rows = stored(_parsed(spark, path, schema).where("file_name <> 'filename'"))
        shape = F.from_json("shape", "name string, x double, y double, width double, height double")
        named = F.from_json("region", "map<string,string>")
        filled = F.map_filter(named, lambda k, v: v.isNotNull() & (v != ""))
        label = F.coalesce(F.try_element_at(filled, F.lit("label")), F.try_element_at(filled, F.lit("class")), F.when(F.size(filled) == 1, F.get(F.map_values(filled), F.lit(0))), F.lit("object"))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        a = rows.withColumn("s", shape).where("s.name = 'rect'").withColumn("label", label)
        a = annotations_of(a, from_xywh(*[zero(F.col(f"s.{k}")) for k in ("x", "y", "width", "height")]))
        names = rows.select("file_name", F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")).distinct()
        return from_raw(with_sizes(a, names, spark, images), a)

    @staticmethod
    def write(ds: AnnotationDataset, path: str) -> None:
        b = box()
        shape = F.to_json(F.struct(F.lit("rect").alias("name"), b.xmin.alias("x"), b.ymin.alias("y"), (b.xmax - b.xmin).alias("width"), (b.ymax - b.ymin).alias("height")))
        region = F.to_json(F.struct(F.col("label")))
        i = per_image(ds, F.struct(shape.alias("shape"), region.alias("region")), "object").withColumn("size", F.lit("0"))
        rows = i.select("file_name", "size", F.size("items").alias("n"), F.posexplode_outer("items").alias("at", "item"))
        line = _line(F.col("file_name"), F.col("size"), F.lit("{}"), F.col("n").cast("string"), F.coalesce("at", F.lit(0)).cast("string"), F.coalesce("item.shape", F.lit("{}")), F.coalesce("item.region", F.lit("{}")))
        write_lines(rows.withColumn("line", line), path, "file_name", "at", header="filename,file_size,file_attributes,region_count,region_id,region_shape_attributes,region_attributes")
