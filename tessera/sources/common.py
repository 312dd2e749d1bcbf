"""What readers and writers share: files as rows, ids by rule, numbers as text, documents from rows.

A reader yields images (file_name, width, height, ...) and annotations (file_name, label, box, ...)
in source order; ``from_raw`` gives them ids. A writer starts from ``per_row`` or ``per_image``.
Writers make a directory of part files. A format that is one JSON or XML document becomes several
whole documents where the data is large; ``shards`` says how many, if not left to the number of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import Box
from tessera.model import AnnotationDataset, dataset, latest, numbered
from tessera.storage import bytes_at, discard, passing, qualified, stored

BOX = ("xmin", "ymin", "xmax", "ymax")


@dataclass(frozen=True)
class Format:
    """A format's name, reader and writer. ``keeps`` tells what survives writing and reading besides boxes and labels."""

    name: str
    read: Callable[..., AnnotationDataset]
    write: Callable[..., None]
    layout: str
    keeps: frozenset[str] = frozenset()


FORMATS: dict[str, Format] = {}


def register(name: str, layout: str, *keeps: str):
    """Class decorator: a class with static ``read(spark, path)`` and ``write(ds, path)`` becomes a format."""

    def add(cls):
        FORMATS[name] = Format(name, cls.read, cls.write, layout, frozenset(keeps))
        return cls

    return add


def lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Rows (line, path, _ord) of text files; ``_ord`` sorts as the lines stand in their files, however the files are split."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return read.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), place.alias("_ord"))


def documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Rows (path, text), one for each file."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return read.select("path", F.decode("content", "UTF-8").alias("text"))


def relative(path: Column, root: str) -> Column:
    """A file's path below ``root``."""
    whole = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).strip("/")
    exact, tail = (f"^(?:.*?/)?{re.escape(x)}/" for x in (whole, whole.split("/")[-1]))
    return F.when(F.rlike(path, F.lit(exact)), F.regexp_replace(path, exact, "")).otherwise(F.regexp_replace(path, tail, ""))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def basename(name: Column) -> Column:
    """The last part of a path or address, without query and fragment."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[?#].*$", ""), r"^file:", ""), r"^.*[/\\]", "")


def require(ok: Column, message: str | Column, value: Column) -> Column:
    """``value``, or an error where ``ok`` doesn't hold."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(message if isinstance(message, Column) else F.lit(message)))


def prefixed(attributes: Column, prefix: str) -> Column:
    """A map's entries that have a value, with ``prefix`` before their keys; no entries for a null map."""
    named = F.transform_keys(F.map_filter(attributes, lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit(prefix), k))
    return F.coalesce(named, F.create_map().cast("map<string,string>"))


def carried(prefix: str, attributes: Column | None = None) -> Column:
    """The attributes whose keys begin with ``prefix``, without it."""
    attributes = F.col("attributes") if attributes is None else attributes
    own = F.map_filter(attributes, lambda k, v: k.startswith(prefix) & (F.length(k) > len(prefix)) & v.isNotNull())
    bare = F.transform_keys(own, lambda k, v: k.substr(F.lit(len(prefix) + 1), F.length(k)))
    return F.coalesce(bare, F.create_map().cast("map<string,string>"))


def attribute(key: str, default: Column | str | None = None) -> Column:
    """One of a row's attributes, or ``default``."""
    return F.coalesce(F.try_element_at("attributes", F.lit(key)), default if isinstance(default, Column) else F.lit(default).cast("string"))


def last_of_each(entries: Column) -> Column:
    """A map from an array of (key, value); of equal keys the last counts, entries without a key don't."""
    def stands(x: Column, n: Column) -> Column:
        return x["key"].isNotNull() & ~F.exists(F.slice(entries, n + 2, F.size(entries)), lambda y: y["key"] == x["key"])

    return F.coalesce(F.map_from_entries(F.filter(entries, stands)), F.create_map().cast("map<string,string>"))


def _filled(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({k: v for k, v in columns.items() if k not in df.columns})


def from_raw(
    images: DataFrame | None, annotations: DataFrame, categories: DataFrame | None = None, info: dict | None = None, licenses: DataFrame | None = None, parsed: tuple[DataFrame, ...] = ()
) -> AnnotationDataset:
    """Ids by rule: images by file name, categories by label, annotations in order.

    Images that only annotations name get the smallest whole size around their boxes; of images
    defined twice the last counts. ``categories`` (name, supercategory, _ord) may list labels
    without annotations. The result reads nothing that was given: stored tables in ``parsed``, from
    which that comes, are discarded.
    """
    none = F.lit(None)
    # parsing is most of the work: once, for sizes, labels and numbers
    raw = a = stored(_filled(annotations, confidence=none.cast("double"), attributes=F.create_map().cast("map<string,string>")))
    seen = a.groupBy("file_name").agg(F.greatest(F.max(F.ceil("xmax")), F.lit(1)).alias("_w"), F.greatest(F.max(F.ceil("ymax")), F.lit(1)).alias("_h"))
    if images is None:
        i = seen.select("file_name", F.col("_w").alias("width"), F.col("_h").alias("height"))
    else:
        i = _filled(images, _ord=F.lit(0), attributes=F.create_map().cast("map<string,string>"))
        i = latest(i, "file_name").drop("_ord").join(seen, "file_name", "full_outer")
        i = i.withColumn("width", F.coalesce(F.col("width").cast("long"), "_w")).withColumn("height", F.coalesce(F.col("height").cast("long"), "_h")).drop("_w", "_h")
    sizes = stored(i)
    i = numbered(sizes, "file_name", name="id")
    c = a.select(F.col("label").alias("name"), none.cast("string").alias("supercategory"), F.lit(1).alias("_given"))
    if categories is not None:
        c = c.union(_filled(categories, supercategory=none.cast("string")).select("name", "supercategory", F.lit(0).alias("_given")))
    c = numbered(c.where("name is not null").groupBy("name").agg(F.min_by("supercategory", "_given").alias("supercategory")), "name", name="id")
    discard(sizes, *parsed)
    a = numbered(a, "_ord", name="id", kept=[x for x in a.columns if x != "_ord"])
    discard(raw)
    named = a.where("file_name is not null and label is not null").select("id", "file_name", "label", *BOX)
    a = a.join(i.select(F.col("file_name").alias("_f"), F.col("id").alias("image_id")), F.col("file_name") == F.col("_f")).join(c.select(F.col("name").alias("_l"), F.col("id").alias("category_id")), F.col("label") == F.col("_l"))
    return dataset(i.withColumn("_ord", F.col("id")), c.withColumn("_ord", F.col("id")), a.withColumn("_ord", F.col("id")), licenses, info).changed(named=named)


def ahead(n: Column) -> Column:
    """The sum of ``n`` over the rows of the task that stand before this one."""

    @F.pandas_udf("long")
    def sums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        total = 0
        for own in batches:
            yield own.cumsum() + (total - own)
            total += int(own.sum())

    return sums.asNondeterministic()(n)


def _starts(totals: DataFrame, key: str, **counts: str) -> DataFrame:
    """Rows (_key, names of ``counts``): the sums of the counted columns over the smaller keys."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col(key).alias("_key"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in counts.items()])


def from_lists(rows: DataFrame, by_name: bool = False) -> AnnotationDataset:
    """``from_raw`` for documents that list boxes by image: rows (path, at, file_name, width, height, boxes), each document's in order in one task.

    ``boxes`` has label, box and perhaps confidence and attributes. Annotations are numbered as they stand, or ``by_name``
    of their images. Only rows of images are sorted, not boxes: their numbers are sums of the lists' sizes.
    """
    size = lambda edge: F.greatest(F.array_max(F.transform(F.col("boxes")[edge], lambda v: F.ceil(v))), F.lit(1))
    some = F.col("_boxes") > 0
    lists = stored(rows.withColumn("_boxes", F.size("boxes")).withColumns({"_w": F.when(some, size("xmax")), "_h": F.when(some, size("ymax")), "_first": F.lit(0) if by_name else ahead(F.col("_boxes"))}))
    placed = lists
    if not by_name:
        of_path = lists.groupBy("path").agg(F.sum("_boxes").alias("_n"), F.min("_first").alias("_least"))
        shift = _starts(of_path, "path", _shift="_n").join(of_path.select("path", "_least"), F.col("_key") == F.col("path")).select("_key", (F.col("_shift") - F.col("_least")).alias("_shift"))
        placed = lists.join(F.broadcast(shift), F.col("path") == F.col("_key")).withColumn("_first", F.col("_first") + F.col("_shift")).drop("_key", "_shift")
    name = Window.partitionBy("file_name").orderBy("path", "at")
    every = name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = placed.repartitionByRange("file_name").withColumns({"_new": (F.row_number().over(name) == 1).cast("int"), "_is": F.lead(F.lit(1)).over(name).isNull(), "_w": F.max("_w").over(every), "_h": F.max("_h").over(every)})
    own = own.withColumns({"_images": ahead(F.col("_new")) + F.col("_new"), "_p": F.spark_partition_id()} | ({"_first": ahead(F.col("_boxes"))} if by_name else {}))
    own = stored(own.drop("path", "at"))
    labels = lists.select(F.explode("boxes.label").alias("name")).where("name is not null").distinct()
    c = numbered(labels.withColumn("supercategory", F.lit(None).cast("string")), "name", name="id")
    discard(lists)
    before = _starts(own.groupBy("_p").agg(F.sum("_new").alias("_i"), F.sum("_boxes").alias("_b")), "_p", _before="_i", _boxes_before="_b")
    own = own.join(F.broadcast(before), F.col("_p") == F.col("_key")).withColumn("image_id", F.col("_images") + F.col("_before"))
    i = own.where("_is").select(F.col("image_id").alias("id"), "file_name", F.coalesce(F.col("width").cast("long"), "_w").alias("width"), F.coalesce(F.col("height").cast("long"), "_h").alias("height"), F.create_map().cast("map<string,string>").alias("attributes"))
    first = F.col("_first") + F.col("_boxes_before") if by_name else F.col("_first")
    a = own.where("file_name is not null").select("image_id", "file_name", first.alias("_first"), F.posexplode("boxes").alias("_k", "x")).select("image_id", "file_name", (F.col("_first") + F.col("_k") + 1).alias("id"), "x.*")
    a = _filled(a, confidence=F.lit(None).cast("double"), attributes=F.create_map().cast("map<string,string>"))
    a = a.join(c.select(F.col("name").alias("_l"), F.col("id").alias("category_id")), F.col("label") == F.col("_l"))
    return dataset(i.withColumn("_ord", F.col("id")), c.withColumn("_ord", F.col("id")), a.withColumn("_ord", F.col("id"))).changed(named=a.select("id", "file_name", "label", *BOX))


def annotations_of(rows: DataFrame, box: Box, *more: Column) -> DataFrame:
    """Raw annotations from rows that have file_name, label and _ord."""
    kept = [c for c in ("confidence", "attributes") if c in rows.columns]
    return rows.select("file_name", "label", *[c.cast("double").alias(n) for c, n in zip(box, BOX, strict=True)], *kept, *more, "_ord")


#: Categories up to which they are sent to the tasks that hold boxes; more are joined by rows.
FEW_CATEGORIES = 500_000


def looked_up(ds: AnnotationDataset, *columns: str) -> DataFrame:
    """Categories by id (_cid, ``columns``), to be joined to boxes; of equal ids the last counts."""
    c = latest(ds.categories.select("id", *columns, "_ord")).withColumnRenamed("id", "_cid").drop("_ord")
    return F.broadcast(c) if ds.categories.limit(FEW_CATEGORIES + 1).count() <= FEW_CATEGORIES else c


def _labelled(ds: AnnotationDataset, missing: str | None, *columns: str) -> DataFrame:
    """Annotations with their category's ``_cid``, ``columns`` and a label. One without its category is an error, or gets the label ``missing``, or is left out if that is 'skip'."""
    rows = ds.annotations.join(looked_up(ds, "name", *columns), F.col("category_id") == F.col("_cid"), "left")
    if missing == "skip":
        return rows.where("_cid is not null").withColumnRenamed("name", "label")
    none = F.lit(missing) if missing else F.raise_error(F.concat(F.lit("annotation "), F.col("id").cast("string"), F.lit(" has no category")))
    return rows.withColumn("label", F.coalesce("name", none)).drop("name")


def _no_image(n: Column) -> Column:
    return F.concat(F.lit("annotation "), n.cast("string"), F.lit(" has no image"))


def per_row(ds: AnnotationDataset, missing: str | None = None) -> DataFrame:
    """Annotations with file_name, width, height, image_attributes and label.

    An annotation without its image is an error. One without its category is an error too, or gets
    the label ``missing``, or is left out if that is 'skip'.
    """
    i = latest(ds.images.select("id", "file_name", "width", "height", F.col("attributes").alias("image_attributes"), "_ord")).withColumnRenamed("id", "_iid").drop("_ord")
    rows = _labelled(ds, missing).join(i, F.col("image_id") == F.col("_iid"), "left")
    return rows.withColumn("file_name", require(F.col("_iid").isNotNull(), _no_image(F.col("id")), F.col("file_name")))


def per_image(
    ds: AnnotationDataset, item: Column, missing: str | None = None, shards: int | None = None, beside: DataFrame | None = None, columns: tuple[str, ...] = (), **more: Column,
) -> DataFrame:
    """Images with ``items``, their annotations as ``item`` in order of id; more arrays by name. An image's annotations are few.

    Images and boxes are brought together by one shuffle: by image or, with ``shards``, by document. Then rows have their ``shard``,
    and ``beside``: rows (shard, beside) that stand in documents beside images are gathered, for each document in one row without an image.
    With ``columns`` of categories, annotations have ``_place``: that of their category among those that their document's boxes name, by ``columns``.
    """
    arrays, by = {"items": item, **more}, [*([] if shards is None else ["shard"]), "image_id", *([] if beside is None else ["_aside"])]
    boxes = _labelled(ds, missing, *columns).drop("_ord").withColumn("_box", F.lit(True))
    if columns:  # a category is missing, or is alike where all columns are
        boxes = boxes.withColumn("_names", F.when(F.col("_cid").isNotNull(), F.struct(F.col("label").alias("name"), *columns))).drop(*columns)
    images = ds.images.select(F.col("id").alias("image_id"), F.struct(*ds.images.columns).alias("_image"))
    rows = boxes.unionByName(images, allowMissingColumns=True)
    if shards is not None:
        rows = rows.withColumn("shard", document_of("image_id", shards))
        if beside is not None:
            rows = rows.unionByName(beside, allowMissingColumns=True).withColumn("_aside", F.col("beside").isNotNull())
        rows = rows.repartitionById(shards, "shard")
        if columns:
            place = F.dense_rank().over(Window.partitionBy("shard").orderBy(F.col("_names").isNull(), "_names")) - 1
            rows = rows.withColumn("_place", F.when(F.col("_names").isNotNull(), place))
    own = F.max_by("_image", "_image._ord").over(Window.partitionBy(*by))
    rows = rows.withColumn("_own", own).withColumns({c: F.col("_own")[c] for c in ("file_name", "width", "height")} | {"image_attributes": F.col("_own.attributes")})
    each = F.when(F.col("_box"), F.struct("id", "_cid", *[c.alias(n) for n, c in arrays.items()]))
    gathered = [F.collect_list("_image").alias("_images"), F.array_sort(F.collect_list(each)).alias("_all"), *([F.collect_list("beside").alias("beside")] if beside is not None else [])]
    grouped = rows.groupBy(*by).agg(*gathered)
    known = require((F.size("_images") > 0) | (F.size("_all") == 0), _no_image(F.get("_all", F.lit(0))["id"]), F.col("_images"))
    kept = [*([] if shards is None else ["shard"]), *([] if beside is None else ["beside"]), *[F.transform("_all", _getter(n)).alias(n) for n in arrays]]
    return grouped.select(F.inline_outer(known) if beside is not None else F.inline(known), *kept)


def with_items(ds: AnnotationDataset, item: Column, missing: str, *columns: str) -> DataFrame:
    """Images (id, file_name, ``columns``) with ``items``, their annotations as ``item`` (of box and label) in order of id. An image's annotations are few.

    As ``per_image``, for items that need nothing of the image: images and boxes are brought together by one grouping, without a join.
    """
    rows = _labelled(ds, missing)
    boxes = rows.select("image_id", F.struct("id", "_cid", item.alias("item")).alias("x"))
    images = ds.images.select(F.col("id").alias("image_id"), F.struct("id", "file_name", *columns).alias("i"))
    grouped = images.unionByName(boxes, allowMissingColumns=True).groupBy("image_id").agg(F.collect_list("i").alias("i"), F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.withColumn("i", require(F.size("i") > 0, _no_image(F.get("x", F.lit(0))["id"]), F.col("i"))).select(F.inline("i"), F.col("x.item").alias("items"))


def _getter(name: str):
    return lambda x: x[name]


def number(c: Column) -> Column:
    """A number as text that gives it back: whole ones without a fraction, no exponents. Infinite ones are an error."""
    c = c.cast("double")
    plain = (F.abs(c) < 1e7) & (F.abs(c) >= 1e-3)
    text = require(c.isNull() | (F.abs(c) < float("inf")), "a number isn't finite", c.cast("string"))
    part = lambda pattern: F.regexp_extract(text, pattern, 1)
    sign, lead, rest, power = part("^(-?)"), part(r"^-?([0-9])"), F.rtrim(part(r"\.([0-9]*)E"), F.lit("0")), part(r"E(-?[0-9]+)$").cast("int")
    large = F.concat(lead, F.rpad(F.substr(rest, F.lit(1), power), power, F.lit("0")), F.when(F.length(rest) > power, F.concat(F.lit("."), F.substr(rest, power + 1))).otherwise(""))
    tiny = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), lead, rest)
    spelt = F.concat(sign, F.when(power > 0, large).otherwise(tiny))
    return F.when(F.isnan(c), "NaN").when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).when(plain, text).otherwise(spelt)


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def csv_cell(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit('[",\n\r]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))


def write_lines(rows: DataFrame, path: str, *order: str, header: str | None = None) -> None:
    """Write the column ``line``, sorted over all parts; every part begins with the header, if there is one."""
    # ranges are found by a pass of its own: over what is stored, not over the joins behind it
    rows = stored(rows.select(*order, "line"))
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line")
    if header is not None:
        # the low bits of the id count rows within a part
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        sorted_ = sorted_.select(F.when(first, F.concat(F.lit(header + "\n"), F.col("line"))).otherwise(F.col("line")).alias("line"))
    with passing(rows.sparkSession):
        sorted_.write.text(path)
    discard(rows)


#: Rows that a document holds where its number is left open.
DOCUMENT_ROWS = 50_000


def shards_for(ds: AnnotationDataset) -> int:
    """Documents that a dataset is cut into: their size stays the same however large it is."""
    return max(1, -(-(ds.images.count() + ds.annotations.count()) // DOCUMENT_ROWS))


def document_of(key: str | Column, shards: int) -> Column:
    """The document, of so many, that what has this key goes to."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def listed_categories(ds: AnnotationDataset, shards: int) -> DataFrame:
    """Categories with the ``shard`` of each document that lists them: those that its boxes name, and each in one document at least.

    Images belong to the document of their id. So lists grow with boxes and categories, not with categories times documents.
    """
    used = ds.annotations.select(document_of("image_id", shards).alias("shard"), F.col("category_id").alias("_c"))
    keys = used.union(ds.categories.select(document_of("id", shards), "id")).distinct()
    return keys.join(ds.categories, F.col("_c") == F.col("id")).drop("_c")


def listed_names(ds: AnnotationDataset, shards: int, *columns: str) -> DataFrame:
    """Rows (shard, id, ``columns``): what each document lists where categories are known by ``columns``, not by id: those of its boxes, and each in one document at least.

    ``id`` is the smallest of the document's categories that are alike. So a list is no longer than there are different names.
    ``bare`` is 0 for those of its boxes, else 1.
    """
    used = ds.annotations.select(document_of("image_id", shards).alias("shard"), "category_id").join(looked_up(ds, *columns), F.col("category_id") == F.col("_cid")).select("shard", *columns, F.col("_cid").alias("id"), F.lit(0).alias("bare"))
    every = ds.categories.groupBy(*columns).agg(F.min("id").alias("id")).select(document_of("id", shards).alias("shard"), *columns, "id", F.lit(1).alias("bare"))
    return used.union(every).groupBy("shard", *columns).agg(F.min("id").alias("id"), F.min("bare").alias("bare")).select("shard", "id", *columns, "bare")


def write_documents(parts: DataFrame, path: str, shards: int, head: str, tail: str, between: str = ",", middles: tuple[str, ...] = ()) -> None:
    """Write documents from rows (key, part) and perhaps ``section`` (from 0) and ``shard``, each document's parts in order of section and key.

    A document is ``head``, its parts with ``between`` before all but the first of a section, and
    ``tail``; the texts of ``middles`` stand before sections 1, 2, ... Documents pass through tasks as streams.
    """
    section = F.col("section") if "section" in parts.columns else F.lit(0)
    shard = F.col("shard") if "shard" in parts.columns else document_of("key", shards)
    rows = parts.select(shard.alias("shard"), section.alias("section"), "key", *[c for c in ("place",) if c in parts.columns], "part")
    # Spark writes a first file in any case: what begins the first document is a row of its own
    begin = {"shard": F.lit(0), "section": F.lit(-1), "part": F.lit("")}
    first = parts.sparkSession.range(0, 1, 1, 1).select(*[begin.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    _write_parts(rows.union(first).repartitionById(shards, "shard"), path, head, tail, between, middles)


def write_images(
    ds: AnnotationDataset, path: str, shards: int, item: Column, parts: list[tuple[Column | None, Column, Column]], head: str, tail: str,
    between: str = ",", middles: tuple[str, ...] = (), missing: str | None = None, beside: DataFrame | None = None, columns: tuple[str, ...] = (), **more: Column,
) -> None:
    """Write documents as ``write_documents`` does, each image in the document of its id: boxes are shuffled once, as numbers, and become text where their document is written.

    ``parts`` (condition or None, key, part), one for each section, are of an image's columns and its arrays as ``per_image`` gives them.
    What stands ``beside`` images are rows (shard, key, part) of a section before theirs.
    """
    lead = 0 if beside is None else 1
    entry = lambda section, key, part: F.struct(section.alias("section"), key.alias("key"), part.alias("part"))
    own = [entry(F.lit(n + lead), key, part) for n, (_, key, part) in enumerate(parts)]
    own = F.array_compact(F.array(*[x if some is None else F.when(some, x) for x, (some, _, _) in zip(own, parts, strict=True)]))
    key = ds.images.limit(0).select(parts[0][1].alias("key")).schema["key"].dataType
    # Spark writes a first file in any case: what begins the first document is a row of its own
    others = ds.images.sparkSession.range(0, 1, 1, 1).select(F.lit(0).alias("shard"), entry(F.lit(-1), F.lit(None).cast(key), F.lit("")).alias("beside"))
    if beside is not None:
        others = others.union(beside.select("shard", entry(F.lit(0), F.col("key").cast(key), F.col("part")).alias("beside")))
    i = per_image(ds, item, missing, shards, others, columns, **more)
    _write_parts(i.select("shard", F.inline(F.when(F.size("beside") > 0, F.col("beside")).otherwise(own))), path, head, tail, between, middles)


def _write_parts(rows: DataFrame, path: str, head: str, tail: str, between: str, middles: tuple[str, ...]) -> None:
    """Write rows (shard, section, key, perhaps place, part), each document's in a partition of its own."""
    order = [c for c in rows.columns if c not in ("shard", "part")]
    within = Window.partitionBy("shard").orderBy(*order)
    rows = rows.withColumns({"_was": F.lag("section").over(within), "_next": F.lead("section").over(within)})

    def among(number: Column, texts: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, texts)), number + 1)

    now, was = F.col("section"), F.col("_was")
    upto = ["".join(middles[:k]) for k in range(len(middles) + 1)]
    rest = ["".join(middles[k:]) + tail for k in range(len(middles) + 1)]
    turn = F.lit("")
    for k in range(len(middles)):
        turn = F.when(was == k, F.substr(among(now, upto), F.lit(len(upto[k]) + 1))).otherwise(turn)
    lead = F.when(now < 0, head).when(was.isNull(), F.concat(F.lit(head), among(now, upto))).when(was < 0, among(now, upto)).when(was == now, between).otherwise(turn)
    end = F.when(F.col("_next").isNull(), F.concat(F.lit("\n"), among(F.greatest(now, F.lit(0)), rest))).otherwise("")
    part = require(F.col("part").isNotNull(), "a part of a document is null", F.col("part"))
    with passing(rows.sparkSession):
        rows.select(F.concat(lead, part, end).alias("value")).write.text(path)


def store_of(root: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    # local paths stand as they are, with blanks and percent signs
    return (fs.LocalFileSystem(), root[7:]) if root.startswith("file:///") else fs.FileSystem.from_uri(root)


def _put(store, at: str, chunks: Iterator[bytes]) -> None:
    """Write a file beside its place and rename it, so a task that is run again leaves whole files."""
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at + ".part") as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(at + ".part", at)


def safe(name: Column) -> Column:
    """``name``, or an error unless it is a relative path that stays below its folder."""
    leaves = F.rlike(name, F.lit(r"^\s*$|^\s*[/\\]|^\s*[A-Za-z]:([/\\]|$)|(^|[/\\])\.\.([/\\]|\s*$)"))
    return require(~leaves, F.concat(F.lit("not a path below the folder: "), F.coalesce(name, F.lit(""))), name)


def write_files(files: DataFrame, root: str) -> None:
    """Write rows (name, content) as files below ``root``, from the tasks that hold them; content is text or bytes."""
    root = qualified(files.sparkSession, root)

    def run(batches):
        store, base = store_of(root)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                _put(store, f"{base}/{name}", iter([content if isinstance(content, bytes) else content.encode()]))
            yield b.select(["name"])

    with passing(files.sparkSession):
        files.select(safe(F.col("name")).alias("name"), "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def write_partitions(rows: DataFrame, root: str, name: str) -> None:
    """Write each partition's ``content`` bytes, in its order, as one file; ``name`` is a format with the partition's number, or the name where there is one partition."""
    root = qualified(rows.sparkSession, root)

    def run(batches):
        from pyspark import TaskContext

        store, base = store_of(root)
        at = name % TaskContext.get().partitionId() if "%" in name else name
        some = (content for b in batches for content in b.column("content").to_pylist())
        first = next(some, None)
        if first is not None or at == name:
            _put(store, f"{base}/{at}", chain([first or b""], some))
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.string())], ["name"])

    with passing(rows.sparkSession):
        rows.select("content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
