"""Large JSON documents read in parallel: the elements of a document as rows, however Spark splits its file.

Files are read as text that ends at each ``}``, so Spark cuts them into ranges anywhere. A first pass sums
up each range without knowing what stands before it: how often quotes toggle, and how brackets change the
depth if the range begins inside a string or outside. Running sums over a file's ranges then give each
range its true state, and a second pass cuts out the elements. What a range ends in the middle of is put
together with the start of the next one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import stored

#: Bytes that a task scans at a time.
CHUNK_BYTES = 4 << 20
#: Ranges beyond the first of their files that may be looked up in tasks; larger ranges make fewer.
MOST_RANGES = 1_000_000

_OPEN, _CLOSE = np.isin(np.arange(256), list(b"[{")), np.isin(np.arange(256), list(b"]}"))
_BRACKET = _OPEN | _CLOSE
_STEP = _OPEN.astype(np.int64) - _CLOSE
_STRUCTURE = _OPEN | _CLOSE | (np.arange(256) == ord(","))
ROWS = "path string, start long, place long, kind string, section string, container string, comma boolean, text string, sure string"


def _text(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Rows (path, start, size, value): text up to each ``}``, with the place of its range and its file's size."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "}").text(path)
    meta = [_named(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")]
    return read.select(*meta, "value")


def _named(path: Column) -> Column:
    """A file's path in one spelling."""
    return F.regexp_replace(path, "^file:/*", "file:///")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """The ranges of a task: the other columns of their rows, and their text in chunks, each ending with ``}``."""
    rows = _rows(batches)
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def texts(key=key) -> Iterator[bytes]:
            nonlocal held
            parts, size = [], 0
            while held is not None and held[0] == key:
                parts.append(held[1])
                size += len(held[1])
                held = next(rows, None)
                if size > CHUNK_BYTES:
                    yield b"".join(parts)
                    parts, size = [], 0
            if parts:
                yield b"".join(parts)

        yield key, texts()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """Runs of equal keys in a batch, with their texts joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.columns[-1].cast(pa.large_binary())
        _, offsets, data = value.buffers()
        edges = np.frombuffer(offsets, np.int64)[value.offset : value.offset + len(value) + 1].tolist()
        raw = memoryview(data) if data is not None else memoryview(b"")
        # keys change where a range ends: few times in a batch
        turns = [np.flatnonzero(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)) + 1 for c in batch.columns[:-1]]
        cuts = [0, *np.unique(np.concatenate(turns)).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            ends = edges[a : b + 1]
            yield tuple(c[a].as_py() for c in batch.columns[:-1]), b"}".join([*[raw[x:y] for x, y in pairwise(ends)], b""])


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where quotes begin or end strings; a quote after an odd number of backslashes doesn't."""
    quote = data == ord('"')
    slash = data == ord("\\")
    if slash.any():
        at = np.arange(len(data))
        other = np.maximum.accumulate(np.where(slash, -1, at))
        before = np.concatenate([[0], at[:-1] - other[:-1]])
        quote &= before % 2 == 0
    return quote


def bounds(text: bytes) -> tuple[int, int]:
    """The greatest depth of a JSON text, and the most bytes between two of its brackets, commas and quotes."""
    data = np.frombuffer(text, np.uint8)
    quote = _quotes(data)
    outside = np.cumsum(quote, dtype=np.uint8) % 2 == 0
    at = np.flatnonzero(_STRUCTURE[data] & outside | quote)
    return int(np.cumsum(_STEP[data[at]] * outside[at]).max(initial=0)), int(np.diff(at, prepend=0, append=len(data)).max())


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, start, size, bytes, toggles, outside, inside, braces_outside, braces_inside, first): what each range does to quotes and depth."""
    for (path, start, size), texts in _ranges(batches):
        toggles, depth, braces, total, first = 0, [0, 0], [0, 0], 0, ""
        for text in texts:
            data = np.frombuffer(text, np.uint8)
            first = first or text.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1")
            quote = _quotes(data)
            at = np.flatnonzero(_BRACKET[data])
            # sums of eight bits are right as to odd and even
            inside = (np.cumsum(quote, dtype=np.uint8)[at] + toggles) % 2
            mark = data[at]
            step, brace = _STEP[mark], (mark == ord("{")).astype(np.int64) - (mark == ord("}"))
            for state in (0, 1):
                depth[state] += int(step[inside == state].sum())
                braces[state] += int(brace[inside == state].sum())
            toggles = (toggles + int(np.count_nonzero(quote))) % 2
            total += len(data)
        values = (path, start, size, total, toggles % 2, depth[0], depth[1], braces[0], braces[1], first)
        yield pa.record_batch([pa.array([v]) for v in values], ["path", "start", "size", "bytes", "toggles", "outside", "inside", "braces_outside", "braces_inside", "first"])


def _cut(states, level: int, sure: Callable | None) -> Callable:
    """Rows of ``ROWS``: the elements at ``level``, and what stands at the ends of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start, _), texts in _ranges(batches):
            inside, depth = states.value.get((path, start), (0, 0))
            open_piece = depth >= level  # the range begins within an element or between two
            section = container = None
            comma, pending, place, roots = False, [], 0, int(start > 0)
            out: list[tuple] = []

            def put(kind: str, text: bytes, comma: bool) -> None:
                nonlocal place
                said = text.decode("utf-8", "replace")
                out.append((path, start, place, kind, section, container, comma, said, sure(section, said) if sure and kind == "element" else None))
                place += 1

            for text in texts:
                data = np.frombuffer(text, np.uint8)
                within = (np.cumsum(_quotes(data), dtype=np.uint8) + np.uint8(inside)) & 1
                at = np.flatnonzero(_STRUCTURE[data] & (within == 0))
                inside = int(within[-1])
                step = _STEP[data[at]]
                after = depth + np.cumsum(step)
                seen = np.minimum(after, after - step) < level
                seen |= (step == 0) & (after == level)
                depth = int(after[-1]) if len(at) else depth
                begin = 0
                for i, before, now in zip(at[seen].tolist(), (after - step)[seen].tolist(), after[seen].tolist(), strict=True):
                    piece, mark = b"".join([*pending, text[begin:i]]), text[i : i + 1]
                    pending, begin = [], i + 1
                    roots += now > before == 0
                    if now > before == 0 and roots > 1:
                        put("error", mark, False)
                    if now > before and now == level:  # a container of elements begins
                        container, section = mark.decode(), _key(piece) if level > 1 else ""
                        comma = False
                        put("section", b"", False)
                    elif before == level:  # an element ends
                        ends_at_comma = mark == b","
                        if not ends_at_comma and container and mark.decode() != {"[": "]", "{": "}"}[container]:
                            put("error", mark, False)
                        if open_piece:
                            put("head", piece, ends_at_comma)
                        elif piece.strip() or comma or ends_at_comma:
                            put("element", piece, comma)
                        open_piece, comma = False, ends_at_comma
                    elif now > before:
                        if piece.strip(b"\xef\xbb\xbf \t\r\n"):
                            put("error", piece, False)
                    elif before == 0:
                        if piece.strip() or now == 0 or i < len(text) - 1:  # a brace at the very end is the one added to the last line
                            put("error", piece + mark, False)
                    elif piece.strip():  # a member that isn't a container
                        container, section = "", _key(piece)
                        put("element", piece[piece.find(b":") + 1 :], False)
                        section = container = None
                pending.append(text[begin:])
                if len(out) > 10_000:
                    yield _batch(out)
                    out.clear()
            rest = b"".join(pending)
            if depth >= level:
                put("middle" if open_piece else "tail", rest, comma)
            elif rest.strip():
                put("error", rest, False)
            if out:
                yield _batch(out)

    return run


def _key(text: bytes) -> str | None:
    """The name before a colon; null where there is none."""
    try:
        return json.loads(text.strip().removesuffix(b":") if text.rstrip().endswith(b":") else text[: text.index(b":")])
    except ValueError:
        return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in ROWS.split(", ")])


#: Folders that elements are kept apart in by their sections.
_PARTS = 16


def part_of(section: Column) -> Column:
    """The folder of a section; null where the section isn't known when an element is cut."""
    return F.when(section.isNotNull(), F.pmod(F.xxhash64(section), F.lit(_PARTS)).cast("int"))


def in_section(rows: DataFrame, *names: str) -> DataFrame:
    """The elements of sections; others are skipped without being read where their sections were known when they were cut."""
    kept = F.col("part").isNull() | reduce(or_, [F.col("part") == part_of(F.lit(n)) for n in names])
    return rows.where(kept & F.col("section").isin(*names))


@dataclass(frozen=True)
class Elements:
    """Elements (path, section, container, start, place, text, sure, part), what holds them (path, section, container), broken documents (path, problem), and all files (path)."""

    rows: DataFrame
    sections: DataFrame
    broken: DataFrame
    files: DataFrame


def elements(spark: SparkSession, path: str, level: int = 1, glob: str = "*", sure: Callable[[str | None, str], str | None] | None = None) -> Elements:
    """The elements of JSON documents.

    At ``level`` 1 elements are those of a document that is an array, or the members ``"key": value`` of
    one that is an object. At ``level`` 2 they are what the lists and objects at the top level hold;
    ``section`` names them, and values that are neither have an empty ``container``. (start, place)
    orders a file's elements. The text of an element isn't parsed here; blank ones between commas
    are kept. ``sure`` of an element's section, if known yet, and text is asked while it is cut; rows carry
    its answer, null for what is put together. A document counts as broken if it is empty, ends within a string or brackets, closes
    more than it opens or goes on after its end; its elements aren't given.
    """
    text = _text(spark, path, glob)
    names = "path string, start long, size long, bytes long, toggles long, outside long, inside long, braces_outside long, braces_inside long, first string"
    sums = stored(text.mapInArrow(_sum_up, names))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("within", F.coalesce(F.sum("toggles").over(before), F.lit(0)) % 2)
    sums = sums.withColumn("step", F.when(F.col("within") == 0, F.col("outside")).otherwise(F.col("inside"))).withColumn("brace", F.when(F.col("within") == 0, F.col("braces_outside")).otherwise(F.col("braces_inside")))
    sums = stored(sums.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0))))
    whole = sums.groupBy("path").agg(F.sum("toggles").alias("toggles"), F.sum("step").alias("depth"), F.sum("brace").alias("braces"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.min("depth").alias("least"), F.min_by("first", "start").alias("first"))
    # the text after the last brace has none of its own; a mark at the file's start isn't read
    added = F.when((F.col("bytes") == F.col("size") + 1) | (F.col("bytes") == F.col("size") - 2), 1).otherwise(0)
    problem = (
        F.when(F.col("toggles") % 2 == 1, "ends within a string").when(~F.col("first").isin("{", "["), "is neither an object nor an array")
        .when(F.col("depth") + added > 0, "ends before its brackets are closed").when((F.col("depth") + added < 0) | (F.col("braces") + added != 0) | (F.col("least") < 0), "closes brackets that it didn't open")
    )
    listed = spark.createDataFrame([(x,) for x in text.inputFiles()], "path string")
    nothing = listed.select(_named(F.col("path")).alias("path")).join(whole, "path", "left_anti").select("path", F.lit("is empty").alias("problem"))
    broken = whole.select("path", problem.alias("problem")).where("problem is not null").unionByName(nothing)
    inner = sums.where("start > 0").select("path", "start", "within", "depth").limit(MOST_RANGES + 1).collect()
    if len(inner) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges of files: raise spark.sql.files.maxPartitionBytes")
    states = spark.sparkContext.broadcast({(r.path, r.start): (r.within, r.depth) for r in inner})
    rows = stored(text.mapInArrow(_cut(states, level, sure), ROWS).withColumn("part", part_of(F.col("section"))), "part")
    more = rows.where("kind = 'error'").select("path", F.concat(F.lit("has text where none belongs: "), F.substring("text", 1, 40)).alias("problem"))
    broken = stored(broken.unionByName(more).groupBy("path").agg(F.min("problem").alias("problem")))
    fine = rows.join(broken.select("path"), "path", "left_anti")
    sections = fine.where("kind = 'section' or container = ''").select("path", "section", "container").distinct()
    return Elements(_put_together(fine), sections, broken, listed.select(_named(F.col("path")).alias("path")))


def _put_together(rows: DataFrame) -> DataFrame:
    """Whole elements: pieces from the ends of ranges joined, sections carried on from range to range."""
    pieces = rows.where("kind in ('head', 'middle', 'tail')")
    order = Window.partitionBy("path").orderBy("start", "place")
    pieces = pieces.withColumn("group", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(order))
    by = F.struct("start", "place", "text")
    joined = pieces.groupBy("path", "group").agg(
        F.min(F.struct("start", "place", "section", "container")).alias("at"), F.max("comma").alias("comma"),
        F.array_join(F.transform(F.array_sort(F.collect_list(by)), lambda x: x["text"]), "").alias("text"),
    )
    joined = joined.where("comma or btrim(text, ' \\t\\r\\n') <> ''").select("path", "at.start", "at.place", "at.section", "at.container", "text", F.lit(None).cast("string").alias("sure"), F.lit(None).cast("int").alias("part"))
    whole = rows.where("kind = 'element'").select("path", "start", "place", "section", "container", "text", "sure", "part").unionByName(joined)
    last = rows.where("kind = 'section'").groupBy("path", "start").agg(F.max_by(F.struct("section", "container"), "place").alias("is"))
    starts = rows.select("path", "start").distinct().join(last, ["path", "start"], "left")
    carried = starts.select(F.col("path").alias("_path"), F.col("start").alias("_start"), F.last("is", True).over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)).alias("was"))
    out = whole.join(F.broadcast(carried.where("was is not null")), (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")), "left")
    known = F.col("container").isNotNull()
    return out.select("path", F.when(known, F.col("section")).otherwise(F.col("was.section")).alias("section"), F.when(known, F.col("container")).otherwise(F.col("was.container")).alias("container"), "start", "place", "text", "sure", "part")
