"""Removing repeated passages: exact counting of word windows, partitioned by super-k-mers.

Every window of ``WINDOW`` words has a minimiser, the smallest hash among its runs of ``RUN``
words. Consecutive windows with the same minimiser travel as one packed string, a super-k-mer,
to the bucket of that minimiser; equal windows always share a bucket. There windows are sorted,
and the smallest document of each distinct window is known exactly. Words under a window that
also starts in a smaller document are removed.

Minimisers met so often that one bucket would swell are split: their windows travel singly,
dealt by their own hash. A task sends a string that several of its documents share once, for
the smallest of them; the others need no answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textops import FACTORS, chunks, column_bytes, joined, single_spaced, spread, utf8, windows_of, word_hashes

WINDOW, RUN = 13, 3
#: Super-k-mers aimed at for a bucket, windows in one string, strings a task holds before it sends them.
BUCKET, STRING_WINDOWS, HELD = 60_000, 256, 200_000
#: A minimiser is split from this many strings on, and from one in so many of all: at most that many are split.
SPLIT_COUNT, SPLIT_SHARE = 20_000, 50_000


def _minimisers(h: np.ndarray) -> np.ndarray:
    """The minimiser of each window of one document's word hashes."""
    g = windows_of(h, RUN)
    need = WINDOW - RUN + 1
    width, low = 1, g
    while 2 * width <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = need - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _segments(low: np.ndarray) -> np.ndarray:
    """Where runs of equal minimisers begin, long runs cut, and the end."""
    cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
    edges = np.concatenate([[0], cuts, [len(low)]])
    if np.diff(edges).max() > STRING_WINDOWS:
        edges = np.unique(np.concatenate([np.arange(a, b, STRING_WINDOWS) for a, b in zip(edges[:-1], edges[1:], strict=True)] + [[len(low)]]))
    return edges


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (low, n): the minimisers a batch has often, and its count of strings under a null."""
    for b in chunks(batches):
        lows = []
        h, _, _, first = word_hashes(*column_bytes(b.column("text")))
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= WINDOW:
                low = _minimisers(h[a:z])
                lows.append(low[_segments(low)[:-1]])
        every = np.sort(np.concatenate(lows)) if lows else np.empty(0, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
        n = np.diff(np.concatenate([first, [len(every)]])) if len(every) else first
        often = n >= max(4, len(every) / SPLIT_SHARE)
        low = pa.array([None, *every[first[often]].view(np.int64).tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([low, pa.array([len(every), *n[often].tolist()], pa.int64())], ["low", "n"])


_SENT = "bucket int, block binary"


def _sender(buckets: int, split: np.ndarray):
    """Documents to blocks: for each bucket the strings of some documents, packed and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        seen: dict[bytes, int] = {}
        sent: list[tuple] = []
        places: list[np.ndarray] = []
        known: list[tuple[int, int, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            place = np.concatenate(places) if places else np.empty(0, np.int64)
            order = np.argsort(place, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1], [True]])) if len(order) else np.empty(0, np.int64)
            names, blocks = [], []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                rows = [sent[i] for i in order[a:z]]
                names.append(int(place[order[a]]))
                head = np.array([(r[0], r[1], r[2]) for r in rows], np.int64)
                blocks.append(pack.compress(_blob(head, b"\n".join([r[3] for r in rows]))))
            if known:
                names.append(known[0][0] % buckets)
                blocks.append(pack.compress(_blob(np.array(known, np.int64), b"")))
            seen.clear(), sent.clear(), places.clear(), known.clear()
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

        for b in chunks(batches):
            lines = [single_spaced(x or b"") for x in b.column("text").cast(pa.binary()).to_pylist()]
            h, word_start, word_end, first = word_hashes(*joined(lines))
            begin = np.cumsum([0, *map(len, lines)])
            for i, (doc, key, line) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), lines, strict=True)):
                own_words = slice(first[i], first[i + 1])
                if doc is None or first[i + 1] - first[i] < WINDOW:
                    continue
                low = _minimisers(h[own_words])
                edges = _segments(low)
                starts, ends = edges[:-1], edges[1:]
                place = low[starts]
                if len(split):
                    at = np.searchsorted(split, place)
                    hot = split[np.minimum(at, len(split) - 1)] == place
                    if hot.any():
                        alone = np.concatenate([np.arange(a, z) for a, z in zip(starts[hot], ends[hot], strict=True)])
                        own = windows_of(h[own_words], WINDOW)[alone]
                        starts, ends, place = np.concatenate([starts[~hot], alone]), np.concatenate([ends[~hot], alone + 1]), np.concatenate([place[~hot], own])
                place = (spread(place) % np.uint64(buckets)).astype(np.int64)
                left = (word_start[own_words][starts] - begin[i]).tolist()
                right = (word_end[own_words][ends + WINDOW - 2] - begin[i]).tolist()
                kept = []
                for j, (a, s, e) in enumerate(zip(starts.tolist(), left, right, strict=True)):
                    string = line[s:e]
                    owner = seen.get(string)
                    if owner is not None and owner < doc:
                        known.append((doc, key, a, int(ends[j]) + WINDOW - 1))
                        continue
                    seen[string] = doc
                    sent.append((doc, key, a, string))
                    kept.append(j)
                places.append(place[kept])
                if len(sent) + len(known) > HELD:
                    yield from flush()
        yield from flush()

    return run


def _blob(head: np.ndarray, text: bytes) -> bytes:
    """Columns of whole numbers, each as differences, then text; ``_unblob`` undoes it."""
    cols = np.diff(head, axis=0, prepend=0).T
    return np.array([head.shape[0], head.shape[1]], np.int64).tobytes() + np.ascontiguousarray(cols).tobytes() + text


def _unblob(blob: bytes) -> tuple[np.ndarray, bytes]:
    n, k = np.frombuffer(blob, np.int64, 2)
    cols = np.frombuffer(blob, np.int64, n * k, 16).reshape(k, n)
    return np.cumsum(cols, axis=1).T, blob[16 + 8 * n * k :]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def _repeats(head: np.ndarray, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(doc, key, from, to): word ranges under windows that a smaller document has too. ``head`` has (doc, key, start)."""
    counts = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
    words = b" ".join(texts).split(b" ")
    names = _Ids()
    ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    del words, names
    per = counts - WINDOW + 1
    offsets = np.cumsum(counts) - counts
    total = int(per.sum())
    entry = np.repeat(np.arange(len(texts)), per)
    inside = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    at = offsets[entry] + inside
    h = windows_of(spread((ids.astype(np.uint64) + np.uint64(1)) * FACTORS[63]), WINDOW)[at]
    doc = head[entry, 0]
    order = np.lexsort((doc, h))
    ho, do = h[order], doc[order]
    new = np.concatenate([[True], ho[1:] != ho[:-1]])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    many = np.diff(np.concatenate([first, [total]]))[group] > 1
    if not many.any():
        return []
    m = np.flatnonzero(many)
    span = np.arange(WINDOW)
    low = do[first[group]]
    for a in range(0, len(m), 1 << 17):
        part = m[a : a + (1 << 17)]
        equal = (ids[at[order[part]][:, None] + span] == ids[at[order[first[group[part]]]][:, None] + span]).all(axis=1)
        for g in np.unique(group[part[~equal]]):  # different windows of one hash: told apart word by word
            rows = np.flatnonzero(group == g)
            smallest: dict[bytes, int] = {}
            texts_of = [ids[at[order[r]] + span].tobytes() for r in rows]
            for r, t in zip(rows, texts_of, strict=True):
                smallest[t] = min(smallest.get(t, do[r]), do[r])
            low[rows] = [smallest[t] for t in texts_of]
    dup = np.sort(order[do > low])
    if not len(dup):
        return []
    start = np.flatnonzero(np.concatenate([[True], (entry[dup][1:] != entry[dup][:-1]) | (inside[dup][1:] != inside[dup][:-1] + 1)]))
    stop = np.concatenate([start[1:] - 1, [len(dup) - 1]])
    e = entry[dup[start]]
    return list(zip(head[e, 0].tolist(), head[e, 1].tolist(), (head[e, 2] + inside[dup[start]]).tolist(), (head[e, 2] + inside[dup[stop]] + WINDOW).tolist(), strict=True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket to rows (doc_id, key, ranges), the ranges of a bucket's documents."""
    unpack = zstandard.ZstdDecompressor()
    now, heads, texts = None, [], []

    def answer(ranges: list) -> Iterator[pa.RecordBatch]:
        if ranges:
            ranges.sort()
            r = np.array(ranges, np.int64)
            cut = np.flatnonzero(np.concatenate([[True], (r[1:, :2] != r[:-1, :2]).any(axis=1), [True]]))
            packed = [r[a:z, 2:].astype(np.int32).tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r[cut[:-1], 0]), pa.array(r[cut[:-1], 1].astype(np.int32)), pa.array(packed, pa.binary())], ["doc_id", "key", "ranges"])

    def done() -> Iterator[pa.RecordBatch]:
        if texts:
            yield from answer(_repeats(np.concatenate(heads), texts))
        heads.clear(), texts.clear()

    for b in batches:
        for bucket, block in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
            if bucket != now:
                yield from done()
                now = bucket
            head, text = _unblob(unpack.decompress(block))
            if head.shape[1] == 4:
                yield from answer([tuple(x) for x in head.tolist()])
            else:
                heads.append(head)
                texts += text.split(b"\n")
    yield from done()


def _cut(words: list[bytes], packed: list[bytes] | None) -> list[bytes]:
    if not packed:
        return words
    keep = np.ones(len(words), bool)
    for p in packed:
        for a, z in np.frombuffer(p, np.int32).reshape(-1, 2).tolist():
            keep[a:z] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key, ranges): packed word ranges to remove; ``key`` is a hash of the text."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("key"), "text")
    often = stored(read.select("text").mapInArrow(_survey, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")))
    total = often.where("low is null").first()
    total = total["n"] if total else 0
    hot = often.where(F.col("low").isNotNull() & (F.col("n") >= max(SPLIT_COUNT, total // SPLIT_SHARE))).select("low").toArrow()
    split = np.sort(np.asarray(hot.column("low").combine_chunks()).astype(np.int64).view(np.uint64))
    buckets = max(64, min(2**31 - 1, total // BUCKET))
    sent = read.mapInArrow(_sender(buckets, split), _SENT)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, "doc_id long, key int, ranges binary")


def _finish(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, out = [], [], []
            for text, packed in zip(b.column("text").to_pylist(), b.column("packed").to_pylist(), strict=True):
                words = utf8(text).split()
                left = _cut(words, packed)
                n.append(len(words))
                gone.append(len(words) - len(left))
                joined = b" ".join(left)
                out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one for each document.

    ``kept`` is the words left, joined by single spaces, or its SHA-256 in hex. Null and short
    texts lose nothing. A null doc_id has no order: such rows lose nothing and remove nothing.
    Rows that share a doc_id don't remove each other's words.
    """
    ranges = stored(repeated_ranges(docs))
    packed = ranges.groupBy("doc_id", "key").agg(F.collect_list("ranges").alias("packed"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("key"), "text")
    joined = read.join(packed, ["doc_id", "key"], "left").select("doc_id", "text", "packed")
    return joined.mapInArrow(_finish(digest), "doc_id long, n_words long, n_removed long, kept string")
