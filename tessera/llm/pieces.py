"""SentencePiece encoding with sampled segmentations, and decoding.

A text, after the customary leading space, is cut into units: a run of spaces with the characters up to
the next space or line break, or a line break; what is longer than ``UNIT`` characters is cut
there. No piece of the vocabulary crosses the other bounds, and in unbroken text none is drawn across a cut. The
pieces that match inside a unit form a lattice. Forward filtering sums the weights of all paths
to each place; backward sampling then draws a path from the end, one piece at a time, with its
exact share. Draws come from a hash of the row's key, the unit's place and the step, so a row is
always cut alike. Characters without a piece are spelled in byte pieces; decoding gives back
every text exactly.

The lattices of all distinct units of a block are filled at once as arrays, however long the text they are from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import _powers_of, chunks, spread

#: Where the vocabulary is, and the exponent of piece weights: less than 1 samples more evenly.
MODEL, ALPHA = "/opt/tokenizers/piece_bpe_32k.model", 1.0
SEED = 17
#: Bytes of text encoded at a time, characters of a block of units, and of a unit at most.
CHUNK, BLOCK, UNIT = 1 << 19, 1 << 19, 512
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Lengths of pieces looked at first.
_NEAR = 8
#: Ids from here on stand for a character spelled in bytes, until the spelling is put in.
_SPELLED = 1 << 24


class Vocabulary:
    """Pieces of a SentencePiece model, by length, with log weights.

    The weights follow Zipf's law in the model's order of pieces, as merge models store ranks and
    no probabilities.
    """

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        ranked = 0
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ranked += 1
                text = piece.replace("▁", " ")
                self.bytes_of[i] = text.encode()
                code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                h = int((_values(code) * _powers_of(_STEP, len(code))).sum())
                by_length.setdefault(len(code), []).append((h, i, -float(np.log(1 + ranked))))
        self.longest = max(by_length)
        self.spell = -ALPHA * float(np.log(size))
        rows = [r for some in by_length.values() for r in some]
        # one table for all pieces, as many places to a slot as the fullest needs; most strings fail at the first look
        sides = int(np.bincount(np.fromiter((r[0] >> 44 for r in rows), np.int64, len(rows))).max())
        self.hash = np.zeros((sides, 1 << 20), np.uint64)
        self.id = np.zeros((sides, 1 << 20), np.int32)
        self.log = np.zeros((sides, 1 << 20), np.float32)
        self.any = np.zeros(1 << 20, np.int8)
        for h, i, w in rows:
            slot = h >> 44
            side = int(self.any[slot])
            self.hash[side, slot], self.id[side, slot], self.log[side, slot], self.any[slot] = h, i, ALPHA * w, side + 1

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, their ids and their log weights."""
        slot = (h >> np.uint64(44)).astype(np.int64)
        may = np.flatnonzero(self.any[slot])
        slot, h = slot[may], h[may]
        hit = self.hash[0, slot] == h
        side = np.zeros(len(slot), np.int64)
        for i in range(1, len(self.hash)):
            more = np.flatnonzero(~hit & (self.any[slot] > i))
            more = more[self.hash[i, slot[more]] == h[more]]
            side[more], hit[more] = i, True
        may, side, slot = may[hit], side[hit], slot[hit]
        return may, self.id[side, slot], self.log[side, slot]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a row of ids, without the leading space."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


def _values(code: np.ndarray) -> np.ndarray:
    return spread(code.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))


def _units(code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where units begin in the texts' characters, and the end."""
    space, line = code == 32, (code == 10) | (code == 13)
    new = np.zeros(len(code), bool)
    new[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    new[edges[:-1]] = True
    begin = np.append(np.flatnonzero(new), len(code))
    size = np.diff(begin)
    cuts = -(-size // UNIT)
    if cuts.max() == 1:
        return begin
    inner = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    return np.append(np.repeat(begin[:-1], cuts) + inner * UNIT, len(code))


def encode_texts(texts: list[str], keys: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, and where each text's begin. ``keys`` seed the draws of each text; an empty text has no ids."""
    parts = [(" " + t).encode("utf-32-le", "surrogatepass") if t else b"" for t in texts]
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)])
    code = np.frombuffer(b"".join(parts), np.uint32)
    if not len(code):
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    full = edges[:-1][np.diff(edges) > 0]
    begin = _units(code, np.append(full, len(code)))
    n_units = len(begin) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values(code) * _powers_of(_STEP, len(code)))])
    back = _powers_of(_BACK, len(code))
    size = np.diff(begin)
    name = spread((sums[begin[1:]] - sums[begin[:-1]]) * back[begin[:-1]] + size.astype(np.uint64))
    text_of = np.searchsorted(full, begin[:-1], "right") - 1
    key = keys[np.flatnonzero(np.diff(edges) > 0)][text_of]
    turn = np.arange(n_units) - np.searchsorted(begin[:-1], full)[text_of]
    seed = spread(key + np.uint64(SEED)) + turn.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)

    ids, count = [], []
    a = 0
    while a < n_units:
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + BLOCK, "right")) - 1)
        got = _sampled(code, begin[a:b], size[a:b], name[a:b], seed[a:b], vocab)
        ids.append(got[0]), count.append(got[1])
        a = b
    out = np.concatenate(ids)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(count))])[np.searchsorted(begin[:-1], edges)]
    if (out >= _SPELLED).any():
        out, bounds = _spell(out, bounds, vocab)
    return out, bounds


def _sampled(code: np.ndarray, begin: np.ndarray, size: np.ndarray, name: np.ndarray, seed: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of units in a row and the number of each, from their beginnings in ``code``, sizes, names and seeds."""
    n_units = len(begin)
    _, first, kind = np.unique(name, return_index=True, return_inverse=True)

    # lattice: a row for each character of a distinct unit, a column for the length of a piece that ends there
    length, start = size[first], begin[first]
    base = np.cumsum(length) - length
    total = int(length.sum())
    inside = np.arange(total) - np.repeat(base, length)
    place = np.repeat(start, length) + inside
    deep = min(vocab.longest, int(length.max()))
    weight = np.full((total, deep), -np.inf, np.float32)
    piece = np.zeros((total, deep), np.int32)
    # ``string`` has the hash of the last n characters at each place, longer by one each turn
    value = _values(code[place])
    string = np.zeros(total, np.uint64)
    for n in range(1, deep + 1):
        string *= np.uint64(_STEP)
        string[n - 1 :] += value[: total - n + 1]
        at = np.flatnonzero(inside >= n - 1)
        hit, ids, w = vocab.find(string[at])
        weight[at[hit], n - 1], piece[at[hit], n - 1] = w, ids
    bare = np.flatnonzero(np.isneginf(weight[:, 0]))
    spelled = code[place[bare]]
    weight[bare, 0] = vocab.spell * _utf8_size(spelled)
    piece[bare, 0] = _SPELLED + spelled.astype(np.int32)

    # forward filtering: ``ahead`` holds the log of the summed weights of all paths to each place
    ahead = np.zeros(total)
    by_size = np.argsort(-length, kind="stable")
    sizes = length[by_size]
    columns = np.arange(deep)
    for e in range(int(length.max())):
        live = base[by_size[: np.searchsorted(-sizes, -e)]] + e
        near = min(deep, e + 1)
        before = ahead[np.maximum(live[:, None] - columns[:near] - 1, 0)]
        if near == e + 1:
            before[:, e] = 0.0
        score = weight[live, :near] + before
        top = score.max(axis=1)
        share = np.exp(score - top[:, None])
        summed = share.sum(axis=1)
        ahead[live] = top + np.log(summed)
        weight[live, :near] = np.cumsum(share / summed[:, None], axis=1)
        weight[live, near:] = 1.0

    # backward sampling: all units step back together
    left = size.copy()
    live = np.arange(n_units)
    near = np.ascontiguousarray(weight[:, :_NEAR])
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        at = base[kind[live]] + left[live] - 1
        u = (spread(seed[live] + np.uint64((len(steps) + 1) * 0x94D049BB133111EB % (1 << 64))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
        # most places are so near the unit's beginning that the first columns tell
        n = (near[at] <= u[:, None]).sum(axis=1)
        far = np.flatnonzero((n >= _NEAR) & (left[live] > _NEAR))
        n[far] = (weight[at[far]] <= u[far, None]).sum(axis=1)
        n = np.minimum(n, np.minimum(deep, left[live]) - 1)
        # rounding may point at a length without a piece; the next shorter one with a piece takes its place
        ids = piece[at, n]
        while not ids.all():
            bad = ids == 0
            n[bad] -= 1
            ids = piece[at, n]
        steps.append((live, ids))
        left[live] -= n + 1
        live = live[left[live] > 0]
    count = np.zeros(n_units, np.int64)
    for units, _ in steps:
        count[units] += 1
    after = np.cumsum(count)
    out = np.empty(int(after[-1]), np.int32)
    for i, (units, ids) in enumerate(steps):
        out[after[units] - 1 - i] = ids
    return out, count


def _utf8_size(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)


def _spell(ids: np.ndarray, bounds: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Put the byte pieces of spelled characters in their places."""
    odd = ids >= _SPELLED
    code = ids[odd] - _SPELLED
    n = np.ones(len(ids), np.int64)
    n[odd] = _utf8_size(code)
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(ids, n)
    raw = np.frombuffer(b"".join(chr(c).encode("utf-8", "surrogatepass") for c in code.tolist()), np.uint8)
    out[np.repeat(odd, n)] = vocab.byte_id[raw]
    return out, begin[bounds]


def _plain(text: str, vocab: Vocabulary) -> np.ndarray:
    """A text spelled in bytes throughout."""
    return vocab.byte_id[np.frombuffer((" " + text).encode("utf-8", "surrogatepass"), np.uint8)]


_ENCODED = "doc_id long, n_pieces long, n_spelled long, lossless boolean"


def _encoder(vocab, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        is_byte = np.zeros(len(v.bytes_of), bool)
        is_byte[v.byte_id] = True
        for b in chunks(batches, CHUNK):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids, bounds = encode_texts(texts, np.asarray(b.column("key")).view(np.uint64), v)
            rows = [ids[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            whole = b"".join((" " + t).encode("utf-8", "surrogatepass") for t in texts if t)
            good = [True] * len(texts)
            if b"".join(map(v.bytes_of.__getitem__, ids.tolist())) != whole:
                for i, (t, r) in enumerate(zip(texts, rows, strict=True)):
                    if t and v.decode(r.tolist()) != t.encode("utf-8", "surrogatepass"):
                        rows[i] = _plain(t, v)
                        good[i] = v.decode(rows[i].tolist()) == t.encode("utf-8", "surrogatepass")
            spelled = [int(is_byte[r].sum()) for r in rows]
            last = pa.array([hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in rows], pa.string()) if digest else pa.array(rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array(spelled, pa.int64()), pa.array(good), last],
                ["doc_id", "n_pieces", "n_spelled", "lossless", "ids_sha256" if digest else "ids"],
            )

    return run


def encode(docs: DataFrame, model: str | None = None, digest: bool = False) -> DataFrame:
    """Rows (doc_id, n_pieces, n_spelled, lossless, ids), one for each document.

    ``ids`` is an array of piece ids, or with ``digest`` the SHA-256 of its little-endian 32-bit
    values as ``ids_sha256``; ``n_spelled`` counts byte pieces; ``lossless`` tells that decoding
    gave the text back. Null and empty texts have no ids and decode to the empty text. The
    segmentation depends on doc_id and the text alone; rows with a null doc_id share one seed, so
    repeated rows are cut alike. An empty table gives no rows. ``model`` is a vocabulary's path,
    else the session's ``spark.tessera.pieces.model``, else ``MODEL``.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(_model(docs, model)))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("key"), "text")
    return read.mapInArrow(_encoder(vocab, digest), _ENCODED + (", ids_sha256 string" if digest else ", ids array<int>"))


def _model(df: DataFrame, model: str | None) -> str:
    return model or df.sparkSession.conf.get("spark.tessera.pieces.model", MODEL)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids); ids outside the vocabulary raise, null ids give a null text."""
    vocab = encoded.sparkSession.sparkContext.broadcast(Vocabulary(_model(encoded, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if r is None else vocab.value.decode(r).decode("utf-8", "surrogatepass") for r in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
