"""Which format a path holds: from the names of a folder's files, else from the shape of a first document or of first lines.

Names and documents are matched by Spark where they lie; only one row of flags and a few lines
come to the driver.
"""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, relative

# Marks in file names below a folder. The first of each format hints at it, all together settle it.
MARKS = {
    "yolo": (r"(^|/)labels/.*\.txt$", r"(^|/)images/|(^|/)data\.yaml$"),
    "yolo-keras": (r"(^|/)yolo_keras[^/]*\.txt$",),
    "yolov4-pytorch": (r"(^|/)yolov4_pytorch[^/]*\.txt$",),
    "voc": (r"^Annotations/.*\.xml$",),
    "cvat": (r"^annotations\.xml$",),
    "ibm-cloud-annotations": (r"^_annotations\.json$",),
    "unity-perception": (r"\.frame_data\.json$|(^|/)captures_[^/]*\.json$",),
    "hf": (r"(^|/)metadata\.(jsonl|parquet)$",),
    "kitti": (r"(?i)^label_2/[^/]+\.txt$", r"^image_2/"),
    "edge-impulse": (r"^bounding_boxes\.labels$",),
    "oidv4": (r"(^|/)Label/[^/]+\.txt$",),
    "cityscapes": (r"_gtFine_polygons\.json$",),
    "supervisely": (r"(^|/)ann/[^/]+\.json$", r"^meta\.json$|^ann/"),
    "superannotate": (r"^classes/classes\.json$", r"(^|/)annotations/[^/]+\.json$"),
}
# Shapes of JSON documents in the order in which they are tried; each needs all its patterns. The first item is the root it may have.
SHAPES = [
    ("edge-impulse", "{", r'"boundingBoxes"\s*:'),
    ("openlabel", "{", r'"openlabel"\s*:\s*\{'),
    ("datumaro", "{", r'"items"\s*:\s*\[', r'"categories"\s*:\s*\{'),
    ("bdd100k", "[{", r'"labels"\s*:\s*\[', r'"box2d"|"videoName"'),
    ("v7-darwin", "[{", r'"item"\s*:\s*\{', r'"annotations"\s*:\s*\['),
    ("labelbox", "[{", r'"data_row"\s*:\s*\{'),
    ("scale-ai", "[{", r'"task_id"\s*:', r'"(response|attachment|params)"\s*:'),
    ("unity-perception", "[{", r'"captures"\s*:\s*\['),
    ("label-studio", "[", r'"data"\s*:\s*\{[^{}]*"image"\s*:\s*"'),
    ("create-ml", "[", r'"image"\s*:\s*"', r'"annotations"\s*:\s*\['),
    ("labelme", "{", r'"shapes"\s*:\s*\['),
    ("ibm-cloud-annotations", "{", r'"type"\s*:\s*"localization"', r'"labels"\s*:\s*\['),
    ("vott-json", "{", r'"asset"\s*:\s*\{', r'"regions"\s*:\s*\['),
    ("superannotate", "{", r'"metadata"\s*:\s*\{', r'"instances"\s*:\s*\['),
    ("cityscapes", "{", r'"imgHeight"\s*:', r'"objects"\s*:\s*\['),
    ("supervisely", "{", r'"size"\s*:\s*\{', r'"objects"\s*:\s*\['),
    ("via", "{", r'"filename"\s*:', r'"regions"\s*:'),
    ("coco", "{", r'"images"\s*:', r'"bbox"\s*:\s*\['),
    ("ir-json", "{", r'"images"\s*:', r'"bbox"\s*:\s*\{|"xmin"\s*:'),
]
LINE_KEYS = [("labelbox", "data_row"), ("sagemaker", "source-ref"), ("hf", "file_name")]
XML_SHAPES = [("cvat", r"<annotations[\s>]"), ("voc", r"<annotation[\s>]"), ("marmot", r"<Page[\s>]")]
VIA_HEADER = ["filename", "file_size", "file_attributes", "region_count", "region_id", "region_shape_attributes", "region_attributes"]
KINDS = {"csv": ("csv",), "tfrecord": ("tfrecord", "tfrecords"), "json": ("json",), "jsonl": ("jsonl", "ndjson", "manifest"), "xml": ("xml",), "txt": ("txt",), "labels": ("labels",), "parquet": ("parquet",)}
#: Lines that are looked at, and characters of each.
HEAD, HEAD_CHARS = 8, 1 << 20


class UnknownFormat(ValueError):
    """No format, or more than one, fits."""


def _names(spark: SparkSession, path: str) -> DataFrame:
    """Names of all files below a path; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(relative(F.col("path"), path).alias("name"))


def detect(spark: SparkSession, path: str) -> str:
    """The name of the format at ``path``; an error tells what speaks for and against each candidate."""
    hits = {f"{f}:{i}": F.max(F.rlike("name", F.lit(p))) for f, marks in MARKS.items() for i, p in enumerate(marks)}
    kinds = {k: F.count_if(F.rlike(F.lower("name"), F.lit(rf"\.({'|'.join(ends)})$")) & ~F.rlike("name", F.lit(r"(^|/)[_.]"))) for k, ends in KINDS.items()}
    row = _names(spark, path).agg(*[c.alias(n) for n, c in hits.items()], *[c.alias(k) for k, c in kinds.items()], F.max("name").alias("last")).first()
    if row["last"] is None:
        raise UnknownFormat(f"{path} holds no files")
    found = {f: [bool(row[f"{f}:{i}"]) for i in range(len(marks))] for f, marks in MARKS.items()}
    whole = [f for f, got in found.items() if all(got)]
    if len(whole) == 1:
        return whole[0]
    if whole:
        raise UnknownFormat(f"{path} fits {', '.join(whole)}; name one")
    present = [k for k in KINDS if row[k]]
    if "json" in present and (f := _json(spark, path)):
        return f
    sniff = {"csv": _csv, "tfrecord": lambda *_: "tfrecord", "jsonl": _json_lines, "xml": _xml, "txt": _txt, "labels": lambda *_: "edge-impulse", "parquet": lambda *_: "hf"}
    for k in [k for k in present if k != "json"] or ["txt"]:
        if f := sniff[k](spark, path):
            return f
    partly = [f"{f} (missing: {', '.join(m for m, g in zip(MARKS[f], got, strict=True) if not g)})" for f, got in found.items() if got[0]]
    raise UnknownFormat(f"{path} fits no format" + (f"; nearest: {'; '.join(partly)}" if partly else "") + "; name one")


def _json(spark: SparkSession, path: str, glob: str = "*.json") -> str | None:
    """The first shape that a first JSON document has; its text stays in the task."""
    one = documents(spark, path, glob).select(F.ltrim("text").alias("text")).limit(1)
    flags = {f"{i}:{j}": F.rlike("text", F.lit(p)) for i, (_, _, *ps) in enumerate(SHAPES) for j, p in enumerate(ps)}
    row = one.select(F.substring("text", 1, 1).alias("root"), *[c.alias(n) for n, c in flags.items()]).first()
    if row is None:
        return None
    return next((f for i, (f, roots, *ps) in enumerate(SHAPES) if row["root"] and row["root"] in roots and all(row[f"{i}:{j}"] for j in range(len(ps)))), None)


def _head(spark: SparkSession, path: str, n: int = HEAD) -> list[str]:
    read = spark.read.option("recursiveFileLookup", "true").text(path)
    return [r["head"] for r in read.where(F.trim("value") != "").select(F.substring("value", 1, HEAD_CHARS).alias("head")).limit(n).collect()]


def _json_lines(spark: SparkSession, path: str) -> str | None:
    """The format of a file whose first line is a whole JSON object with a key of its own."""
    try:
        first = json.loads((_head(spark, path, 1) or [""])[0])
    except ValueError:
        return None
    return next((f for f, key in LINE_KEYS if isinstance(first, dict) and key in first), None)


def _xml(spark: SparkSession, path: str, glob: str = "*.xml") -> str | None:
    one = documents(spark, path, glob).limit(1)
    row = one.select(*[F.rlike("text", F.lit(p)).alias(f) for f, p in XML_SHAPES]).first()
    return next((f for f, _ in XML_SHAPES if row and row[f]), None)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _shares(cells: list[str]) -> bool:
    """Whether all cells are numbers from 0 to 1."""
    return all((x := _number(c)) is not None and 0 <= x <= 1 for c in cells)


def _by_range(rows: list[list[str]]) -> str:
    """Boxes in columns 5 to 8: pixels if any lies beyond 0 to 1."""
    cells = [_number(c) for r in rows if len(r) >= 8 for c in r[4:8]]
    return "udacity" if any(x is not None and not 0 <= x <= 1 for x in cells) else "tfod"


def csv_format(lines: list[str]) -> str | None:
    """The format of a CSV file by its first lines."""
    rows = list(csv.reader(lines))
    if not rows:
        return None
    first, low = rows[0], [c.strip().lower() for c in rows[0]]
    n = len(first)
    if n == 5 and (low[0] == "image_id" and low[3] == "bbox" or first[3].strip()[:1] == "[" and first[1].strip().isdigit()):
        return "kaggle-wheat"
    if low == ["image", "xmin", "ymin", "xmax", "ymax", "label"]:
        return "vott-csv"
    if [c.lstrip("#") for c in low] == VIA_HEADER:
        return "via-csv"
    if n == 6:
        return "retinanet"
    if n in (8, 13) and low[0] == "imageid":
        return "openimages"
    if n in (9, 11) and (low[0] in ("set", "ml_use", "train", "validation", "test", "unassigned") or n == 11 and not first[5] and not first[6]):
        return "automl-vision"
    if n == 8:
        if low[0] == "filename":
            return _by_range(rows[1:])
        if first[0] and _number(first[1]) is None and _number(first[3]) is not None and _shares(first[4:8]):
            return "openimages"
        return _by_range(rows)
    return "openimages" if n == 13 else None


def _csv(spark: SparkSession, path: str) -> str | None:
    return csv_format(_head(spark, path))


def txt_format(lines: list[str], name: str) -> str | None:
    """The format of a text file by its first lines, and by its name where two have the same grammar."""
    name = name.lower().replace("-", "_")
    tokens = [x.split() for x in lines]
    if len(tokens) > 2 and len(tokens[0]) == 1 and tokens[0][0].isdigit() and _number(" ".join(tokens[1])) is None and len(tokens[2]) == 1 and tokens[2][0].isdigit():
        return "wider-face"
    if ("oidv4" in name or "openimages_v4" in name) and all(len(t) >= 5 and all(_number(x) is not None for x in t[-4:]) for t in tokens):
        return "oidv4"
    rows = all(all(len(b.split(",")) == 5 and all(_number(x) is not None for x in b.split(",")) for b in t[1:]) for t in tokens)
    if rows and tokens:
        return next((f for f, keys in (("yolo-keras", ("yolo_keras", "keras_yolo")), ("yolov4-pytorch", ("yolov4_pytorch", "pytorch_yolov4"))) if any(k in name for k in keys)), None)
    return None


def _txt(spark: SparkSession, path: str) -> str | None:
    """Text files; Spark's writers give this ending to documents and tables too, so their first sign decides."""
    lines = _head(spark, path)
    sign = lines[0].lstrip()[:1] if lines else ""
    if sign in ("{", "["):
        return _json_lines(spark, path) or _json(spark, path, "*")
    if sign == "<":
        return _xml(spark, path, "*")
    return txt_format(lines, path.rstrip("/").rsplit("/", 1)[-1]) or (csv_format(lines) if lines and "," in lines[0] and len(lines[0].split(",")) > 4 else None)
