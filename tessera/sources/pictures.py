"""Sizes of images from the heads of their files, read by range.

Files are listed without their bytes. Only files that something refers to are opened, each by the task that
holds its row: one read of ``HEAD`` bytes, and short reads further on where a JPEG's size stands behind long
segments. Nothing else of a file is read, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import qualified

from .common import relative, require, store_of

#: Bytes of the first read of an image, and of each one after it.
HEAD, FURTHER = 1 << 16, 1 << 12
#: Reads that a task has under way at once, and files that a task looks at.
ABREAST, PER_TASK = 8, 2_000
#: Endings of image files; the first five are tried, in this order, for a reference without an ending.
ENDINGS = ("jpg", "jpeg", "png", "bmp", "webp")
_LISTED = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in (*ENDINGS, "gif")) + "}"

Read = Callable[[int, int], bytes]


def _jpeg(read: Read, window: bytes) -> tuple[int, int] | None:
    """The size in a JPEG's first frame header, by its segments; ``window`` is the head of the file."""
    at, base = 2, 0
    while True:
        if at - base + 9 > len(window):
            base, window = at, read(at, FURTHER)
        mark = window[at - base : at - base + 9]
        if len(mark) < 9 or mark[0] != 0xFF:
            return None
        kind, length = mark[1], int.from_bytes(mark[2:4], "big")
        if kind == 0xFF:  # a filling byte before a marker
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without a segment
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(mark[7:9], "big"), int.from_bytes(mark[5:7], "big")
        elif kind in (0xD9, 0xDA) or length < 2:  # picture data or the end: no frame header came
            return None
        else:
            at += 2 + length


def size_in(read: Read) -> tuple[int, int] | None:
    """Width and height of a PNG, JPEG, GIF, BMP or WebP image; ``read(at, n)`` gives up to ``n`` of its bytes. None if there is no size."""
    data = read(0, HEAD)
    big, little = (lambda a, b: int.from_bytes(data[a:b], "big")), (lambda a, b: int.from_bytes(data[a:b], "little"))
    size = None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        size = big(16, 20), big(20, 24)
    elif data[:2] == b"BM" and len(data) >= 26:
        if little(14, 18) == 12:
            size = little(18, 20), little(20, 22)
        else:
            size = little(18, 22), abs(int.from_bytes(data[22:26], "little", signed=True))
    elif data[:4] == b"GIF8" and len(data) >= 10:
        size = little(6, 8), little(8, 10)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            size = 1 + little(24, 27), 1 + little(27, 30)
        elif data[12:16] == b"VP8L":
            size = (little(21, 25) & 0x3FFF) + 1, (little(21, 25) >> 14 & 0x3FFF) + 1
        elif data[12:16] == b"VP8 ":
            size = little(26, 28) & 0x3FFF, little(28, 30) & 0x3FFF
    elif data[:2] == b"\xff\xd8":
        size = _jpeg(read, data)
    return size if size and min(size) > 0 else None


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Rows (name) of the image files below ``root``, by path below it; no bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _LISTED).load(root)
    return files.select(relative(F.col("path"), root).alias("name"))


def sized(rows: DataFrame, root: str, at: str) -> DataFrame:
    """``rows`` with width and height of the image at path ``at`` below ``root``; null where ``at`` is. A file without a size is an error."""
    whole = qualified(rows.sparkSession, root)

    @F.pandas_udf("width long, height long")
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        store, base = store_of(whole)

        def one(name: str | None) -> tuple[int | None, int | None]:
            if name is None:
                return None, None
            with store.open_input_file(f"{base.rstrip('/')}/{name}") as f:
                return size_in(lambda start, n: f.read_at(min(n, max(0, f.size() - start)), start)) or (None, None)

        with ThreadPoolExecutor(ABREAST) as pool:
            for names in batches:
                yield pd.DataFrame(list(pool.map(one, names)), columns=["width", "height"], dtype="Int64")

    got = rows.drop("width", "height").withColumn("_size", probe(F.col(at)))
    width = require(F.col(at).isNull() | F.col("_size.width").isNotNull(), F.concat(F.lit("no size found in image "), F.col(at)), F.col("_size.width"))
    return got.withColumns({"width": width, "height": F.col("_size.height")}).drop("_size")


def image_sizes(spark: SparkSession, root: str, without: str = "^images/") -> DataFrame:
    """Rows (name, width, height) of all image files below ``root``, by path below it less ``without``."""
    return sized(listing(spark, root), root, "name").select(F.regexp_replace("name", without, "").alias("name"), "width", "height")


def places(files: DataFrame, guessed: bool = False) -> DataFrame:
    """Rows (key, place): the file that a reference ``key`` means, of the files (name) of a listing.

    A reference with an ending means the file of that path, or else the one below ``images/``. For one without,
    the endings are tried in order, both places each. With ``guessed`` the same goes for a reference whose ``.jpg``
    was put there by a reader and has no file.
    """
    name, flat = F.col("name"), F.regexp_replace("name", "^images/", "")
    bare = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    ending = F.array_position(F.array(*map(F.lit, ENDINGS)), F.regexp_extract("name", r"\.([^./]*)$", 1)).cast("int") * 2
    inner = name != flat
    way = lambda key, rank, ok=None: F.when(F.lit(True) if ok is None else ok, F.struct(key.alias("key"), rank.alias("way")))
    ways = [way(name, F.lit(0)), way(flat, F.lit(1), inner)]
    for end in ["", ".jpg"] if guessed else [""]:
        ways += [way(F.concat(bare(name), F.lit(end)), ending, ending > 0), way(F.concat(bare(flat), F.lit(end)), ending + 1, (ending > 0) & inner)]
    each = files.select("name", F.inline(F.array_compact(F.array(*ways))))
    return each.groupBy("key").agg(F.min_by("name", F.struct("way", "name")).alias("place"))


def with_sizes(annotations: DataFrame, images: DataFrame | None, spark: SparkSession, root: str | None, otherwise: Column | None = None, guessed: bool = False) -> DataFrame | None:
    """``images`` with sizes from the files below ``root`` that they mean (``places``); null sizes are left to the boxes.

    ``otherwise`` is a second reference, tried where the file name finds nothing. Files that no image means aren't opened.
    """
    names = annotations.select("file_name").distinct() if images is None else images
    if root is None:
        return images
    files = listing(spark, root)
    known = places(files, guessed).withColumnsRenamed({"key": "_key", "place": "_place"})
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./+)+", "")
    keyed = names.drop("width", "height").withColumn("_ref", plain(F.col("file_name")))
    found = keyed.join(known, F.col("_ref") == F.col("_key"), "left").drop("_key", "_ref")
    if otherwise is not None:
        second = known.withColumnsRenamed({"_key": "_key2", "_place": "_place2"})
        found = found.withColumn("_ref", plain(otherwise)).join(second, F.col("_ref") == F.col("_key2"), "left").withColumn("_place", F.coalesce("_place", "_place2")).drop("_ref", "_key2", "_place2")
    # opening files takes the time, not the rows: a number of tasks by files, which no re-planning by bytes merges
    tasks = -(-files.count() // PER_TASK)
    return sized(found.repartition(max(1, tasks), "file_name"), root, "_place").drop("_place")
