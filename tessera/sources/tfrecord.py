"""TFRecord files of detection examples: framed, checksummed protocol buffers.

Files are read in byte ranges, several tasks to a large file. A range begins at the first place whose eight
bytes, as a record's length, fit the checksum after them and the file's size. Such a place may by chance, or by
design, lie inside a record. So the ranges of a file are held against each other first: each must begin where the
records before it end. Where one doesn't, the file is read from its start by one task, which also finds what is
broken. The rows are the same wherever files are cut.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import box, to_normalized, to_pixel
from tessera.model import AnnotationDataset
from tessera.storage import qualified, stored

from .common import annotations_of, from_raw, per_image, register, require, shards_for, store_of, write_partitions
from .elements import _named

#: Bytes of a range, of a read, and of records whose checksums are computed together.
SPLIT_BYTES, READ_BYTES, TOGETHER = 64 << 20, 1 << 20, 4 << 20


def _crc_table() -> list[int]:
    """The table of CRC-32C, from its reflected polynomial."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


_TABLE = _crc_table()


_TABLE_ARRAY = np.array(_TABLE, np.uint32)
_ONE = _TABLE_ARRAY[np.arange(1 << 16, dtype=np.uint32) & 0xFF] ^ np.arange(1 << 16, dtype=np.uint32) >> 8
#: The table for two bytes at a time.
_PAIRS = _TABLE_ARRAY[_ONE & 0xFF] ^ _ONE >> 8
#: Bytes from which a checksum is computed in lanes.
_LANES_FROM = 2048
#: At place k what 2 ** k zero bytes do to a checksum's state, as a table for each of its four bytes.
_ZEROS: list[np.ndarray] = []


def _through(state: np.ndarray, power: int) -> np.ndarray:
    """States after 2 ** ``power`` zero bytes."""
    while len(_ZEROS) <= power:
        bits = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
        _ZEROS.append(_TABLE_ARRAY[bits & 0xFF] ^ bits >> 8 if not _ZEROS else _through(_ZEROS[-1], len(_ZEROS) - 1))
    table = _ZEROS[power]
    return table[0][state & 0xFF] ^ table[1][state >> 8 & 0xFF] ^ table[2][state >> 16 & 0xFF] ^ table[3][state >> 24]


def crc32c(data: bytes) -> int:
    """CRC-32C. Long data is cut into lanes that go through the table side by side and are put together pair by pair."""
    if len(data) < _LANES_FROM:
        crc = 0xFFFFFFFF
        for byte in data:
            crc = _TABLE[(crc ^ byte) & 0xFF] ^ crc >> 8
        return crc ^ 0xFFFFFFFF
    # zero bytes before all others change nothing if the first state is zero; the usual one is put into the first four bytes instead
    power = max(3, min(8, len(data).bit_length() - 11))
    lanes = 1 << (len(data) - 1 >> power).bit_length()
    padded = np.zeros(lanes << power, np.uint8)
    padded[-len(data) :] = np.frombuffer(data, np.uint8)
    padded[len(padded) - len(data) :][:4] ^= 0xFF
    state = np.zeros(lanes, np.uint32)
    for column in np.ascontiguousarray(padded.reshape(lanes, -1).T):
        state = _TABLE_ARRAY[(state ^ column) & 0xFF] ^ state >> 8
    while len(state) > 1:
        state = _through(state[0::2], power) ^ state[1::2]
        power += 1
    return int(state[0]) ^ 0xFFFFFFFF


def crc32c_each(bodies: list[bytes]) -> list[int]:
    """CRC-32C of each of several records; short ones of like length go through the table side by side."""
    out = [0] * len(bodies)
    alike: dict[int, list[int]] = {}
    for i, body in enumerate(bodies):
        if 4 <= len(body) < _LANES_FROM:
            alike.setdefault(len(body).bit_length(), []).append(i)
        else:
            out[i] = crc32c(body)
    for places in alike.values():
        width = -(-max(len(bodies[i]) for i in places) // 2) * 2
        padded = np.zeros((len(places), width), np.uint8)
        for row, i in zip(padded, places, strict=True):
            row[width - len(bodies[i]) :] = np.frombuffer(bodies[i], np.uint8)
            row[width - len(bodies[i]) :][:4] ^= 0xFF
        state = np.zeros(len(places), np.uint32)
        for column in np.ascontiguousarray(padded.view("<u2").T):
            state = _PAIRS[(state ^ column) & 0xFFFF] ^ state >> 16
        for i, crc in zip(places, state.tolist(), strict=True):
            out[i] = crc ^ 0xFFFFFFFF
    return out


def _masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    return _masked(crc32c(data))


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked_crc(head)) + data + struct.pack("<I", masked_crc(data))


def frame_each(bodies: list[bytes]) -> list[bytes]:
    """``frame`` of each of several records, their checksums computed together."""
    heads = [struct.pack("<Q", len(body)) for body in bodies]
    checks = [struct.pack("<I", _masked(crc)) for crc in crc32c_each(heads + bodies)]
    return [head + a + body + b for head, a, body, b in zip(heads, checks, bodies, checks[len(bodies) :], strict=False)]


def _length(head: bytes) -> int | None:
    """A record's length from the twelve bytes before it; None if its checksum doesn't fit."""
    fits = len(head) == 12 and struct.unpack_from("<I", head, 8)[0] == masked_crc(head[:8])
    return struct.unpack_from("<Q", head)[0] if fits else None


def first_record(read, start: int, end: int, size: int) -> int | None:
    """The first place in a range that looks like the start of a record; ``read(at, n)`` gives bytes of the file, ``size`` is its length."""
    for base in range(start, end, READ_BYTES):
        data = np.frombuffer(read(base, min(READ_BYTES, end - base) + 11), np.uint8)
        n = len(data) - 11
        if n <= 0:
            return None
        state = np.full(n, 0xFFFFFFFF, np.uint32)
        for k in range(8):
            state = _TABLE_ARRAY[(state ^ data[k : k + n]) & 0xFF] ^ state >> 8
        crc = ~state
        said = sum(data[8 + k : 8 + k + n].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
        for at in np.flatnonzero((crc >> 15 | crc << 17) + np.uint32(0xA282EAD8) == said).tolist():
            if base + at + 16 + int.from_bytes(data[at : at + 8].tobytes(), "little") <= size:
                return base + at
    return None


def records(f, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Rows (place, body) of the records that begin in a range, the first at its start, with their checksums held against them."""
    f.seek(start)
    stream = io.BufferedReader(f, READ_BYTES)

    def checked() -> Iterator[tuple[int, bytes]]:
        crcs = crc32c_each([body for _, body, _ in held])
        for (at, body, said), crc in zip(held, crcs, strict=True):
            if _masked(crc) != said:
                raise ValueError(f"broken record at byte {at}")
            yield at, body

    at, held, weight = start, [], 0
    while at < end:
        n = _length(stream.read(12))
        if n is None or at + 16 + n > size:
            yield from checked()
            raise ValueError(f"broken record length at byte {at}" if n is None else f"broken record at byte {at}")
        held.append((at, stream.read(n), int.from_bytes(stream.read(4), "little")))
        at, weight = at + 16 + n, weight + n
        if weight > TOGETHER:
            yield from checked()
            held, weight = [], 0
    yield from checked()


def _opened(root: str, path: str):
    """A file at or below a folder, by their addresses."""
    store, base = store_of(root)
    if not path.startswith(root):
        store, base, root = *store_of(path), path
    return store.open_input_file(base + path[len(root) :])


def _long_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


#: Numbers of up to two bytes, which most lengths and sizes are.
_SHORT = [_long_varint(n) for n in range(1 << 14)]


def _varint(n: int) -> bytes:
    return _SHORT[n] if 0 <= n < 16384 else _long_varint(n)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def encode_example(features: dict[str, list]) -> bytes:
    """An example message; bytes, floats and whole numbers become lists of their kind."""
    entries = b""
    for key in sorted(features):
        values = features[key]
        if values and isinstance(values[0], bytes):
            value = _field(1, b"".join(_field(1, v) for v in values))
        elif values and isinstance(values[0], float):
            value = _field(2, _field(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            value = _field(3, _field(1, b"".join(map(_varint, values))))
        entries += _field(1, _field(1, key.encode()) + _field(2, value))
    return _field(1, entries)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _fields(data: bytes) -> list[tuple[int, bytes | int]]:
    at, end, out = 0, len(data), []
    while at < end:
        # most numbers are of one byte or two
        tag = data[at]
        at += 1
        if tag > 127:
            tag, at = _read_varint(data, at - 1)
        if tag & 7 == 2:
            n = data[at]
            at += 1
            if n > 127:
                n, at = _read_varint(data, at - 1)
            out.append((tag >> 3, data[at : at + n]))
            at += n
        elif tag & 7 == 5:
            out.append((tag >> 3, data[at : at + 4]))
            at += 4
        elif tag & 7 == 0:
            n, at = _read_varint(data, at)
            out.append((tag >> 3, n))
        else:
            out.append((tag >> 3, data[at : at + 8]))
            at += 8
    return out


def _values(kind: int, body: bytes) -> list:
    """The values of a list of bytes, floats or whole numbers."""
    values: list = []
    if kind == 2 and len(body) > 1 and body[0] == 10 and body[1] == len(body) - 2 < 128:  # one packed list
        return list(struct.unpack_from(f"<{body[1] // 4}f", body, 2))
    for _, v in _fields(body):
        if kind == 1:
            values.append(v)
        elif kind == 2:
            values += struct.unpack(f"<{len(v) // 4}f", v)
        elif isinstance(v, int):
            values.append(v - (1 << 64) if v >> 63 else v)
        elif max(v, default=0) < 128:  # each byte is a number
            values += v
        else:
            at = 0
            while at < len(v):
                n, at = _read_varint(v, at)
                values.append(n - (1 << 64) if n >> 63 else n)
    return values


def _usual(entry: bytes) -> tuple[bytes, int, bytes] | None:
    """The name, kind and list of an entry that holds just these in this order, with a name and lists of less than 16 KB; else None."""
    if len(entry) < 6 or entry[0] != 10 or entry[1] > 127:
        return None
    at = 2 + entry[1]
    key = entry[2:at]
    for tags in ((18,), (10, 18, 26)):  # the value, and in it the list of one kind; each must reach to the end
        if len(entry) < at + 2 or entry[at] not in tags:
            return None
        kind, n = entry[at] >> 3, entry[at + 1]
        at += 2
        if n > 127:
            if at >= len(entry) or entry[at] > 127:
                return None
            n, at = n & 127 | entry[at] << 7, at + 1
        if at + n != len(entry):
            return None
    return key, kind, entry[at:]


def _features(data: bytes) -> dict[bytes, list]:
    """The lists of an example by the bytes of their names."""
    out: dict[bytes, list] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            usual = _usual(entry)
            if usual is not None:
                out[usual[0]] = _values(usual[1], usual[2])
                continue
            parts = dict(_fields(entry))
            values: list = []
            for kind, body in _fields(parts.get(2, b"")):
                values += _values(kind, body)
            out[parts[1]] = values
    return out


def decode_example(data: bytes) -> dict[str, list]:
    return {key.decode(): values for key, values in _features(data).items()}


def _entry(key: bytes, kind: int, body: bytes) -> bytes:
    """An example's list of one kind under its name, a field already; ``body`` holds the values."""
    inner = _LIST_TAGS[kind] + _varint(len(body)) + body
    value = key + b"\x12" + _varint(len(inner)) + inner
    return b"\x0a" + _varint(len(value)) + value


_LIST_TAGS = {k: _varint(k << 3 | 2) for k in (1, 2, 3)}


def _whole(key: bytes, values: list[int]) -> bytes:
    return _entry(key, 3, _field(1, b"".join(map(_varint, values))))


def _real(key: bytes, packed: bytes) -> bytes:
    """Floats, packed; an empty list has no kind and stands as one of whole numbers."""
    return _entry(key, 2, _field(1, packed)) if packed else _whole(key, [])


def _encoded(b: pa.RecordBatch) -> list[bytes]:
    """Example messages of images with their ``items``, as ``encode_example`` writes them; values are taken by column."""
    lists = b.column("items")
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int).tolist()
    bounds = {}
    for e in _EDGES:
        column = flat.field(e)
        wide = column.to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            narrow = wide.astype("<f4")
        if column.null_count or (np.isinf(narrow) & np.isfinite(wide)).any():
            raise ValueError("a box has no coordinate, or one too large for a 32-bit float")
        bounds[f"image/object/bbox/{e}"] = narrow.tobytes()
    texts = {t: _field(1, t.encode()) for t in flat.field("label").unique().to_pylist()}
    label = [texts[t] for t in flat.field("label").to_pylist()]
    number = flat.field("c").to_pylist()
    more = {feature: flat.field(k).to_pylist() for k, feature in (_WHOLES | _FLOATS).items() if flat.field(k).null_count < len(flat)}
    reals = set(_FLOATS.values())
    given = {feature: b.column(k).to_pylist() for k, feature in _OF_IMAGE.items() if b.column(k).null_count < b.num_rows}
    named = {f: _field(1, f.encode()) for f in ("image/filename", "image/width", "image/height", _TEXTS.decode(), _CLASS_LABEL[1], *(f"image/object/bbox/{e}" for e in _EDGES), *more, *given)}
    order = sorted(named)
    out = []
    for n, (name, width, height) in enumerate(zip(b.column("file_name").to_pylist(), b.column("width").to_pylist(), b.column("height").to_pylist(), strict=True)):
        p, q = ends[n], ends[n + 1]
        parts = []
        for f in order:
            key = named[f]
            if f in bounds:
                parts.append(_real(key, bounds[f][4 * p : 4 * q]))
            elif f == "image/filename":
                parts.append(_entry(key, 1, _field(1, name.encode())))
            elif f == "image/width" or f == "image/height":
                parts.append(_whole(key, [width if f == "image/width" else height]))
            elif f == _CLASS_LABEL[1]:
                parts.append(_whole(key, number[p:q]))
            elif f in given:
                if given[f][n] is not None:
                    parts.append(_entry(key, 1, _field(1, given[f][n].encode())))
            elif f in more:
                if q > p and None not in (mine := more[f][p:q]):
                    parts.append(_real(key, struct.pack(f"<{q - p}f", *mine)) if f in reals else _whole(key, mine))
            else:
                parts.append(_entry(key, 1, b"".join(label[p:q])) if q > p else _whole(key, []))
        out.append(_field(1, b"".join(parts)))
    return out


_EDGES = ("xmin", "ymin", "xmax", "ymax")
#: Attributes of images and of objects, with the features they are carried in; objects' are floats or whole numbers.
_OF_IMAGE = {"tfrecord_source_id": "image/source_id", "tfrecord_key_sha256": "image/key/sha256", "tfrecord_format": "image/format"}
_HAD_PICTURE = ("tfrecord_had_encoded_image", "image/encoded")
_CLASS_LABEL = ("tfrecord_class_label", "image/object/class/label")
_FLOATS = {"area": "image/object/area", "tfrecord_weight": "image/object/weight"}
_WHOLES = {"iscrowd": "image/object/is_crowd", "difficult": "image/object/difficult", "tfrecord_group_of": "image/object/group_of"}
_OTHERS = ("tfrecord_unsupported_feature_count", "tfrecord_unsupported_feature_keys")
#: All features that are read.
_KNOWN = {"image/filename", "image/width", "image/height", "image/object/class/text", *_OF_IMAGE.values(), _HAD_PICTURE[1], _CLASS_LABEL[1], *_FLOATS.values(), *_WHOLES.values(), *(f"image/object/bbox/{e}" for e in _EDGES)}
_MAP = pa.map_(pa.string(), pa.string())
_SCHEMA = pa.schema([
    ("path", pa.string()), ("at", pa.int64()), ("file_name", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("texts", pa.list_(pa.string())), ("labels", pa.list_(pa.int64())),
    *[(e, pa.list_(pa.float64())) for e in _EDGES], ("attributes", _MAP), ("own", pa.list_(_MAP)), ("others", pa.list_(pa.string())),
])
_ROW = (
    "path string, at long, file_name string, width long, height long, texts array<string>, labels array<long>, "
    "xmin array<double>, ymin array<double>, xmax array<double>, ymax array<double>, attributes map<string,string>, own array<map<string,string>>, others array<string>"
)


def _single(x: float) -> str:
    """The shortest text of a 32-bit float, without an exponent."""
    return np.format_float_positional(np.float32(x), unique=True, trim="-")


_FILE_NAME, _WIDTH, _HEIGHT, _TEXTS = b"image/filename", b"image/width", b"image/height", b"image/object/class/text"
_BOX_KEYS = [f"image/object/bbox/{e}".encode() for e in _EDGES]
#: Attributes of objects in the order of their maps: name, feature, and whether values are 32-bit floats.
_OWN = [(_CLASS_LABEL[0], _CLASS_LABEL[1].encode(), False), *((k, f.encode(), True) for k, f in _FLOATS.items()), *((k, f.encode(), False) for k, f in _WHOLES.items())]
_OF_IMAGE_KEYS = [(k, f.encode()) for k, f in _OF_IMAGE.items()]
_KNOWN_KEYS = frozenset(k.encode() for k in _KNOWN)


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for v in values for x in v], kind))


def _maps(entries: list[list[tuple[str, str]]]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, entries)], dtype=np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([k for e in entries for k, _ in e], pa.string()), pa.array([v for e in entries for _, v in e], pa.string()))


def _batch_of(path: str, places: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    """Examples as rows; lists of attributes may be shorter than the boxes."""
    names, widths, heights, texts, labels, attributes, others = [], [], [], [], [], [], []
    edges: tuple[list, ...] = ([], [], [], [])
    own, counts = [], [0]
    for body in bodies:
        e = _features(body)
        get = e.get
        boxes = [get(k, ()) for k in _BOX_KEYS]
        for held, values in zip(edges, boxes, strict=True):
            held.append(values)
        n = max(map(len, boxes))
        numbers = get(_OWN[0][1], [])
        labels.append(numbers)
        mine: list[list[tuple[str, str]]] = [[] for _ in range(n)]
        for key, feature, real in _OWN:
            if values := get(feature):
                for entries, value in zip(mine, values, strict=False):
                    entries.append((key, _single(value) if real else str(value)))
        own += mine
        counts.append(n)
        found = [(k, e[f][0].decode()) for k, f in _OF_IMAGE_KEYS if get(f)]
        if get(_HAD_PICTURE[1].encode()):
            found.append((_HAD_PICTURE[0], "true"))
        attributes.append(found)
        names.append((get(_FILE_NAME) or [b""])[0].decode())
        widths.append((get(_WIDTH) or [0])[0])
        heights.append((get(_HEIGHT) or [0])[0])
        texts.append([t.decode() for t in get(_TEXTS, ())])
        others.append([] if e.keys() <= _KNOWN_KEYS else sorted(k.decode() for k in e.keys() - _KNOWN_KEYS))
    of_own = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32), pa.int32()), _maps(own))
    columns = [
        pa.array([path] * len(bodies), pa.string()), pa.array(places, pa.int64()), pa.array(names, pa.string()), pa.array(widths, pa.int64()), pa.array(heights, pa.int64()), _lists(texts, pa.string()), _lists(labels, pa.int64()),
        *[_lists(v, pa.float64()) for v in edges], _maps(attributes), of_own, _lists(others, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


#: Examples of a batch.
_BATCH = 512


def ranges(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """Rows (path, start, end, size): ranges of the files at or below ``path``, each beginning with a record."""
    root = qualified(spark, path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    listed = listed.select(_named(F.col("path")).alias("path"), F.col("length").alias("size"))
    tasks = max(1, -(-(listed.agg(F.sum("size")).first()[0] or 0) // split_bytes))
    whole = listed.select("path", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), "size")
    cut = listed.where(F.col("size") > split_bytes).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "size")
    cut = cut.withColumn("end", F.least(F.col("start") + split_bytes, "size"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first record of each range and the end of its last one, by lengths alone; -1 where one is broken."""
        for b in batches:
            firsts, nexts = [], []
            for r in b.to_pylist():
                with _opened(root, r["path"]) as f:
                    first = 0 if r["start"] == 0 else first_record(lambda at, n: f.read_at(n, at), r["start"], r["end"], r["size"])  # noqa: B023
                    at = first
                    if first is not None:
                        f.seek(first)
                        stream = io.BufferedReader(f, READ_BYTES)
                        while 0 <= at < r["end"]:
                            n = _length(stream.read(12))
                            at = -1 if n is None or at + 16 + n > r["size"] else at + 16 + n
                            if at >= 0:
                                stream.seek(n + 4, io.SEEK_CUR)
                    firsts.append(first), nexts.append(at)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("path", "start", "end", "size")], pa.array(firsts, pa.int64()), pa.array(nexts, pa.int64())], ["path", "start", "end", "size", "first", "next"])

    if not cut.isEmpty():
        found = stored(cut.repartition(tasks, "path", "start").mapInArrow(bounds, "path string, start long, end long, size long, first long, next long"))
        before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        due = F.coalesce(F.last("next", ignorenulls=True).over(before), F.lit(0).cast("long"))
        fits = F.when(F.col("first").isNull(), due >= F.col("end")).otherwise((F.col("first") == due) & (F.col("next") >= 0))
        found = found.withColumn("fits", fits).withColumn("sure", F.min("fits").over(Window.partitionBy("path")))
        apart = found.where("sure and first is not null").select("path", F.col("first").alias("start"), "end", "size")
        unsure = found.where("not sure and start = 0").select("path", "start", F.col("size").alias("end"), "size")
        whole = whole.where(F.col("size") <= split_bytes).unionByName(apart).unionByName(unsure)
    # reading and decoding take the time, not these rows: a number of tasks by bytes, which no re-planning merges
    return whole.repartition(tasks, "path", "start")


def _examples(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                places, bodies = [], []
                with _opened(root, r["path"]) as f:
                    for at, body in records(f, r["start"], r["end"], r["size"]):
                        places.append(at), bodies.append(body)
                        if len(places) == _BATCH:
                            yield _batch_of(r["path"], places, bodies)
                            places, bodies = [], []
                if places:
                    yield _batch_of(r["path"], places, bodies)

    return run


@register("tfrecord", "framed examples, boxes as 32-bit shares")
class TfRecord:
    @staticmethod
    def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> AnnotationDataset:
        """Of examples of one image each attribute's first value counts; sizes that differ are an error, as is an example without a name."""
        rows = ranges(spark, path, split_bytes).mapInArrow(_examples(qualified(spark, path)), _ROW)
        n = F.size("xmin")
        same = (F.size("xmax") == n) & (F.size("ymin") == n) & (F.size("ymax") == n) & ((F.size("texts") == n) | ((F.size("texts") == 0) & (F.size("labels") == n)))
        fine = require(same & (F.col("width") > 0) & (F.col("height") > 0), "an example's lists differ in length or its size is missing", F.col("file_name"))
        # decoding is most of the work: once, for images, labels and boxes
        rows = parsed = stored(rows.withColumn("file_name", require(F.col("file_name") != "", "an example has no file name", fine)))
        first = lambda k: F.min_by(F.col("attributes")[k], F.when(F.col("attributes")[k].isNotNull(), F.struct("path", "at"))).alias(k)
        keys = [*_OF_IMAGE, _HAD_PICTURE[0]]
        images = rows.groupBy("file_name").agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in ("width", "height")], *map(first, keys))
        alike = (F.col("width.a") == F.col("width.b")) & (F.col("height.a") == F.col("height.b"))
        width = require(alike, F.concat(F.lit("examples differ in the size of image "), F.col("file_name")), F.col("width.a"))
        kept = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))]), lambda k, v: v.isNotNull())
        images = images.select("file_name", width.alias("width"), F.col("height.a").alias("height"), kept.alias("attributes"))
        name = F.coalesce(F.get("texts", F.col("k")), F.get("labels", F.col("k")).cast("string"))
        a = rows.select("*", F.posexplode("xmin").alias("k", "x0")).select("file_name", "width", "height", name.alias("label"), F.col("x0").alias("xmin"), *[F.get(e, F.col("k")).alias(e) for e in _EDGES[1:]], F.get("own", F.col("k")).alias("attributes"), F.struct("file_name", "path", "at", "k").alias("_ord"))
        # feature names are a schema's, not data's: few
        others = sorted(r["k"] for r in rows.select(F.explode("others").alias("k")).distinct().collect())
        info = {"attributes": dict(zip(_OTHERS, (str(len(others)), ",".join(others)), strict=True))} if others else None
        return from_raw(images, annotations_of(a, to_pixel(box(), F.col("width"), F.col("height"))), info=info, parsed=(parsed,))

    @staticmethod
    def write(ds: AnnotationDataset, path: str, shards: int | None = None) -> None:
        """Attributes of objects are written where all objects of an image have them as numbers."""
        n = to_normalized(box(), F.col("width").cast("double"), F.col("height").cast("double"))
        whole = lambda k: F.expr(f"try_cast(attributes['{k}'] as bigint)").alias(k)
        real = lambda k: F.expr(f"try_cast(attributes['{k}'] as float)").alias(k)
        i: DataFrame = per_image(ds, F.struct("label", F.coalesce(whole(_CLASS_LABEL[0]), F.col("category_id")).alias("c"), *n.named(), *map(whole, _WHOLES), *map(real, _FLOATS)))
        i = i.withColumn("file_name", require((F.col("width") > 0) & (F.col("height") > 0), "an image has no size", F.col("file_name")))
        i = i.withColumns({k: F.col("attributes")[k] for k in _OF_IMAGE})

        def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # checksums of a few thousand records at a time fill the lanes and stay small
                for k in range(0, b.num_rows, 4096):
                    some = b.slice(k, 4096)
                    yield pa.RecordBatch.from_arrays([some.column("file_name"), pa.array(frame_each(_encoded(some)), pa.binary())], ["file_name", "content"])

        dealt = i.select("id", "file_name", "width", "height", "items", *_OF_IMAGE).repartition(shards or shards_for(ds), "file_name").sortWithinPartitions("file_name", "id")
        write_partitions(dealt.mapInArrow(examples, "file_name string, content binary"), path, "data-%05d.tfrecord")
