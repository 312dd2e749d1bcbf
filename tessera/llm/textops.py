"""Words and word hashes inside tasks: small numpy helpers over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

#: Bytes of text handled at a time, so that a task's arrays stay small.
CHUNK_BYTES = 1 << 20


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def spread(h: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit hashes, so that order and low bits look random."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random value for each byte, and one with A-Z as a-z; the step from a byte to the next in a word's hash, and back.
_VALUES = np.array([xxhash.xxh3_64_intdigest(bytes([i]), 1) for i in range(256)], np.uint64)
_LOWER = _VALUES[[i + 32 if 65 <= i <= 90 else i for i in range(256)]]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, CHUNK_BYTES + (1 << 16)), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def word_hashes(data: np.ndarray, edges: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words in ``data`` (bytes), and where each text's words begin.

    ``edges`` has the bounds of the texts. A word's hash is a polynomial in random values of its
    bytes, taken from running sums, so no word becomes an object of its own.
    """
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(len(edges), np.int64)
    blank = _BLANK[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, blank[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, blank[1:]
    inner = edges[(edges > 0) & (edges < n)]
    before[inner], after[inner - 1] = True, True
    starts = np.flatnonzero(before & ~blank)
    ends = np.flatnonzero(after & ~blank) + 1
    sums = np.cumsum((_LOWER if lower else _VALUES)[data] * _powers_of(_STEP, n))
    h = sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    h = spread(h * _powers_of(_BACK, n)[starts] + (ends - starts).astype(np.uint64))
    return h, starts, ends, np.searchsorted(starts, edges)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts and their bounds; null texts are empty."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null(b"") if column.null_count else column
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, edges - edges[0]


_SPACED = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


def single_spaced(raw: bytes) -> bytes:
    """The words of a text joined by single spaces."""
    line = raw.translate(_SPACED)
    return b" ".join(line.split()) if b"  " in line or line[:1] == b" " or line[-1:] == b" " else line


def joined(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one array of bytes, and their bounds."""
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))])
    return np.frombuffer(b"".join(lines), np.uint8), edges


#: Odd factors for the words of a shingle or window, by place.
FACTORS = np.array([xxhash.xxh3_64_intdigest(bytes([i])) | 1 for i in range(64)], np.uint64)


def windows_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * FACTORS[0]
    for i in range(1, k):
        out += h[i : i + n] * FACTORS[i]
    return spread(out)


def give_back() -> None:
    """Return what freed arrays leave behind to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches where their text passes ``limit`` bytes; a row stays whole."""
    give_back()
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        start, total = 0, 0
        for i, n in enumerate(sizes.to_pylist()):
            total += n
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


class Tally:
    """Sums by 64-bit key inside a task; hands them on when it holds too many."""

    def __init__(self, most: int = 500_000):
        self.most, self.keys, self.sums, self.held = most, [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self._put(keys[first], np.diff(np.concatenate([first, [len(keys)]])))

    def _put(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys), self.sums.append(sums)
        self.held += len(keys)
        if self.held > 2 * self.most:
            self._merge()

    def _merge(self) -> None:
        keys, sums = np.concatenate(self.keys), np.concatenate(self.sums)
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.sums = [keys[first]], [np.add.reduceat(sums, first) if len(first) else sums]
        self.held = len(first)

    def full(self) -> bool:
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        self._merge()
        out = self.keys[0], self.sums[0]
        self.keys, self.sums, self.held = [], [], 0
        return out
