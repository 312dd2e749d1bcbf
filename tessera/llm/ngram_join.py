"""Near-duplicate documents: an exact Jaccard join on word shingles over trees of count vectors.

Every distinct shingle set is one node; copies only count towards their class. Shingles are
hashed into groups, and the counts of the groups are a point. For two points the summed minima
of their coordinates bound the overlap of the sets from above.

Documents meet in blocks: two sets as similar as asked must share a shingle among the first few
of each, in any order common to all. The order here begins with the shingles whose words are
rarest in the corpus, so blocks stay small. Within a block a tree of boxes over the points (an R-tree, packed in order of size)
finds the pairs whose bound allows a link; those are verified on the whole sets. A first round
links each document of a block to a leader. The second takes the sets of documents that may link
to another component along and links what is not yet connected, in place: large groups
never list all their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, small, stored
from .textops import Tally, chunks, column_bytes, spread, windows_of, word_hashes

#: Groups that shingles are hashed into: the dimensions of a point.
GROUPS = 256
#: Coordinates are kept up to this; sets of more shingles are met by size alone.
LARGE = 65_535
#: Points in a leaf, children of a box; blocks up to a leaf are compared flat.
FANOUT = 32
#: A word has a score from this many occurrences on; so many words at most have one, and so high at most.
OFTEN, OFTEN_KEPT, SCORES = 8, 1 << 20, 50
#: Rows of one shingle held at a time; a longer run is a block of its own and isn't merged with equal ones.
RUN_HELD = 200_000
#: Members of a group, and shingles of a cluster's sets, in one piece of it.
PIECE, PIECE_SHINGLES = 512, 1 << 22
#: Bits of the bitmap that lets most documents without a block skip the second reading.
BITMAP = 1 << 23


class Rarity:
    """Scores of words, 0 for the rarest: the logarithm of their number of occurrences."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.scores = words, np.minimum(np.log2(np.maximum(counts, 1)), SCORES).astype(np.int64)

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.scores[at], 0)


def shingle_sets(column: pa.Array, k: int, rarity: Rarity) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text: its runs of ``k`` words, or all its words if they are fewer.

    A shingle is a number: in its top byte the summed scores of its words, below them a hash. So
    rare shingles come first in order.
    """
    h, _, _, first = word_hashes(*column_bytes(column), lower=True)
    sums = np.concatenate([[0], np.cumsum(rarity.of(h))])

    def numbers(hashes: np.ndarray, score: np.ndarray) -> np.ndarray:
        return (np.minimum(score, 255).astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))

    runs = windows_of(h, k)
    runs = numbers(runs, sums[k:] - sums[:-k]) if len(runs) else runs
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            u = np.sort(runs[a : b - k + 1])
            keep = np.empty(len(u), bool)
            keep[0] = True
            np.not_equal(u[1:], u[:-1], out=keep[1:])
            yield u[keep]
        else:
            yield numbers(windows_of(h[a:b], b - a), sums[b : b + 1] - sums[a]) if b > a else h[:0]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()

    def out() -> pa.RecordBatch:
        keys, n = tally.take()
        some = n >= 2
        return pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some])], ["word", "n"])

    for b in chunks(batches):
        tally.add(word_hashes(*column_bytes(b.column("text")), lower=True)[0])
        if tally.full():
            yield out()
    yield out()


def rarities(docs: DataFrame) -> Rarity:
    """Scores of the words that occur often. They steer the order of shingles only; any scores give the same links."""
    counts = docs.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = stored(counts.where(F.col("n") >= OFTEN))
    least = OFTEN
    while often.where(F.col("n") >= least).count() > OFTEN_KEPT:
        least *= 2
    got = often.where(F.col("n") >= least).toArrow()
    words, n = np.asarray(got.column("word").combine_chunks()).astype(np.int64).view(np.uint64), np.asarray(got.column("n").combine_chunks())
    discard(often)
    order = np.argsort(words)
    return Rarity(words[order], n[order])


_SKETCH = "doc_id long, n long, node long, check long, point binary, prefix array<long>"


def _digest(shingles: bytes) -> tuple[int, int]:
    """Two whole numbers that name a set."""
    digest = xxhash.xxh3_128_intdigest(shingles)
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (digest & (1 << 64) - 1, digest >> 64))


def _sketch(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in chunks(batches):
            rows = []
            for u in shingle_sets(b.column("text"), k, shared.value):
                n = len(u)
                if not n:
                    rows.append((0, None, None, None, None))
                    continue
                node, check = _digest(u.tobytes())
                prefix = None
                if (node, check) not in seen:  # a copy's prefix has been sent by this task
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add((node, check))
                    prefix = u[: n + percent * n // -100 + 1].view(np.int64)
                point = np.minimum(np.bincount((u & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), LARGE).astype(np.uint16).tobytes()
                rows.append((n, node, check, point, prefix))
            n, node, check, point, prefix = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(point, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "n", "node", "check", "point", "prefix"],
            )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, node) in order to rows (block, node): the nodes that share a shingle, equal blocks of a task once."""
    done: set[int] = set()
    t0, d0 = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(t: np.ndarray, d: np.ndarray, whole: bool) -> pa.RecordBatch | None:
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        n = np.diff(np.concatenate([first, [len(t)]]))
        names = spread(np.add.reduceat(spread(d.view(np.uint64)), first) + n.astype(np.uint64)).view(np.int64) if whole else t[first]
        many = n > 1
        if whole:
            fresh = np.zeros(len(n), bool)
            for i in np.flatnonzero(many).tolist():
                if (x := int(names[i])) not in done:
                    done.add(x)
                    fresh[i] = True
            many = fresh
            if len(done) > 300_000:
                done.clear()
        rows = np.repeat(many, n)
        if not rows.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)[rows]), pa.array(d[rows])], ["block", "node"])

    long_run = None
    for b in batches:
        t, d = np.concatenate([t0, np.asarray(b.column("shingle"))]), np.concatenate([d0, np.asarray(b.column("node"))])
        if not len(t):
            continue
        keep = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
        t, d = t[keep], d[keep]
        last = int(np.searchsorted(t, t[-1]))
        if last and long_run is not None:
            end = int(np.searchsorted(t, long_run, "right"))
            yield pa.RecordBatch.from_arrays([pa.array(t[:end]), pa.array(d[:end])], ["block", "node"])
            t, d, last, long_run = t[end:], d[end:], last - end, None
        if last and (x := out(t[:last], d[:last], True)):
            yield x
        t0, d0 = t[last:], d[last:]
        if len(t0) > RUN_HELD:
            long_run = int(t0[0])
            yield pa.RecordBatch.from_arrays([pa.array(t0[:-1]), pa.array(d0[:-1])], ["block", "node"])
            t0, d0 = t0[-1:], d0[-1:]
    if len(t0):
        if long_run is not None:
            yield pa.RecordBatch.from_arrays([pa.array(t0), pa.array(d0)], ["block", "node"])
        elif x := out(t0, d0, True):
            yield x


class PointTree:
    """Boxes over points in order of size, packed ``FANOUT`` to a box; a box keeps its upper corner and its sizes' range.

    A search descends only into boxes where the summed minima with the upper corner still allow
    the overlap asked for.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray, percent: int):
        self.percent = percent
        self.levels = [(sizes, sizes, points)]
        while len(self.levels[-1][0]) > FANOUT:
            low, high, corner = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(corner, at)))

    def search(self, size: int, point: np.ndarray, after: int) -> np.ndarray:
        """Places beyond ``after`` whose bound allows a link with the point."""
        p = self.percent
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, corner = self.levels[depth]
            at = at[(at + 1) * FANOUT**depth > after + 1]
            lo = np.maximum(low[at], -(-p * size // 100))
            fits = (lo <= high[at]) & (100 * size >= p * low[at])
            at, lo = at[fits], lo[fits]
            bound = np.minimum(corner[at], point).sum(axis=1, dtype=np.int64)
            at = at[(bound * (100 + p) >= p * (size + lo)) | (np.maximum(size, lo) > LARGE)]
            if depth and len(at):
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows that share ``key``, from batches in its order; small groups of a batch come together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        name = np.asarray(b.column(key))
        last = int(np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))[-1])
        if held and name[0] != held[-1].column(key)[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _members(rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, rep, n, points) of each group in the rows."""
    deal, rep, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("deal", "rep", "n"))
    point = np.frombuffer(b"".join(rows.column("point").to_pylist()), np.uint16).reshape(len(rep), GROUPS)
    first = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1], [True]])).tolist()
    for s, e in zip(first[:-1], first[1:], strict=True):
        yield s, e, rep[s:e], n[s:e], point[s:e]


def _leaders(percent: int):
    """Each member of a group that isn't a leader, paired with one leader whose bound allows a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "deal"):
            pairs = []
            for _, _, rep, n, point in _members(rows):
                tree, free = PointTree(n, point, percent), np.ones(len(n), bool)
                for i in range(len(n) - 1):
                    if free[i]:
                        j = tree.search(int(n[i]), point[i], i)
                        j = j[free[j]]
                        free[j] = False
                        pairs.append(np.stack([np.minimum(rep[j], rep[i]), np.maximum(rep[j], rep[i])], axis=1))
            if pairs:
                found = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _touched(percent: int):
    """The members of a group whose bound allows a link with one of another component, each with the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "deal"):
            component = np.asarray(rows.column("component").combine_chunks())
            found = []
            for s, e, rep, n, point in _members(rows):
                keep = np.zeros(e - s, bool)
                own = component[s:e]
                if (own == own[0]).all():
                    continue
                tree = PointTree(n, point, percent)
                for i in range(e - s - 1):
                    j = tree.search(int(n[i]), point[i], i)
                    j = j[own[j] != own[i]]
                    if len(j):
                        keep[i] = True
                        keep[j] = True
                if keep.any():
                    some = np.unique(rep[keep])
                    found.append(np.stack([some, np.full(len(some), some[0])], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _joined_up(percent: int):
    """Links inside groups between members not yet connected, each verified on the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "deal"):
            component = rows.column("component").to_pylist()
            shingles = rows.column("shingles").combine_chunks()
            a, b = [], []
            for s, e, rep, n, point in _members(rows):
                sets = [np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in range(s, e)]
                top = {c: c for c in component[s:e]}

                def find(c: int, top: dict = top) -> int:
                    while top[c] != c:
                        top[c] = c = top[top[c]]
                    return c

                tree = PointTree(n, point, percent)
                for i in range(e - s - 1):
                    for j in tree.search(int(n[i]), point[i], i).tolist():
                        x, y = find(component[s + i]), find(component[s + j])
                        if x != y and _linked(sets[i], sets[j], percent):
                            top[x] = y
                            a.append(min(rep[i], rep[j])), b.append(max(rep[i], rep[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * both >= percent * (len(u) + len(v) - both)


def _sets(k: int, bitmap: np.ndarray, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.asarray(b.column("slot"))
            some = (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            for c in chunks([b.filter(pa.array(some.astype(bool)))]):
                sets = [u.tobytes() or None for u in shingle_sets(c.column("text"), k, shared.value)]
                names = [(None, None) if x is None else _digest(x) for x in sets]
                node, check = ([x[i] for x in names] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "node", "check", "shingles"])

    return run


def _slot(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BITMAP))


def whole_sets(docs: DataFrame, nodes: DataFrame, k: int, shared) -> DataFrame:
    """Rows (doc_id, node, check, shingles) for the documents in ``nodes`` (rep), and perhaps some others."""
    words = nodes.select(_slot("rep").alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP // 64, np.int64)
    bitmap[np.asarray(words.column("w").combine_chunks())] = np.asarray(words.column("bits").combine_chunks())
    return docs.select("doc_id", "text", _slot("doc_id").alias("slot")).mapInArrow(_sets(k, bitmap.view(np.uint64), shared), "doc_id long, node long, check long, shingles binary").where("shingles is not null")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def ngram_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each document.

    Documents link when the Jaccard similarity of their sets of ``k``-word shingles is at least
    ``percent`` / 100; component_id is the smallest doc_id reachable by links. Documents without
    words, null texts included, have an empty set and stay alone. Rows with a null doc_id link
    to nothing and get a null component; rows that share a doc_id are one node.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(rarities(read))
    sketch = stored(read.mapInArrow(_sketch(k, percent, shared), _SKETCH))
    full = sketch.where("n > 0 and doc_id is not null")
    # a set is named by two 64-bit digests; blocks know the first only
    classes = stored(full.groupBy("node", "check").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("point").alias("point")))

    tokens = full.select(F.explode("prefix").alias("shingle"), "node").repartition("shingle").sortWithinPartitions("shingle", "node")
    blocks = stored(tokens.mapInArrow(_blocks, "block long, node long").distinct().join(classes.select("node", "rep", "n", "point"), "node").select("block", "rep", "n", "point"))
    # points and prefixes have served: from here on a document is its set's name
    names = stored(sketch.select("doc_id", "n", "node", "check"))
    discard(sketch)
    full = names.where("n > 0 and doc_id is not null")

    # a large block is dealt by size first: linked sets are in the same or in neighbouring bands
    large = small(blocks.groupBy("block").count().where(F.col("count") > PIECE).select("block", F.lit(True).alias("large")))
    # a hair wider than the ratio of sizes that may link, so rounding can't part neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(100.0 / percent)) * 1.0001)) if percent < 100 else F.col("n")
    dealt = blocks.join(large, "block", "left").withColumn("band", F.explode(F.when(F.col("large"), F.array(band - 1, band)).otherwise(F.array(F.lit(0).cast("long"))))).drop("large")

    def in_groups(rows: DataFrame) -> DataFrame:
        return rows.repartition("deal").sortWithinPartitions("deal", "n", "rep")

    # then in pieces
    pieces = dealt.groupBy("block", "band").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    dealt = stored(dealt.join(pieces, ["block", "band"]).select(F.xxhash64("block", "band").alias("block"), F.pmod(F.xxhash64("rep"), F.col("pieces")).alias("piece"), "pieces", "rep", "n", "point"))
    discard(blocks)
    parts = dealt.select(F.xxhash64("block", "piece").alias("deal"), "rep", "n", "point")
    pairs = in_groups(parts).mapInArrow(_leaders(percent), "a long, b long").where("a <> b")
    same = stored(classes.groupBy("node").count().where("count > 1").select("node"))
    if same.limit(1).count():  # sets whose first digests are equal, one in some 10^19 pairs, are candidates of each other
        few = classes.join(small(same), "node").select("node", "rep")
        pairs = pairs.union(few.join(few.withColumnRenamed("rep", "b"), "node").where("rep < b").select(F.col("rep").alias("a"), "b"))
    pairs = stored(pairs.distinct())
    sets = stored(whole_sets(read, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), k, shared))
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
    first = stored(both.mapInArrow(_verify(percent), "a long, b long"))
    discard(pairs, sets, same)
    found = components(first).select(F.col("node").alias("rep"), "component")

    # every two members of different components meet once more; most blocks are one component by now
    again = dealt.join(found, "rep", "left").select("block", "rep", "n", "point", F.coalesce("component", "rep").alias("component"))
    met, *kept = _meeting(again, "block", lambda side: F.ceil(F.count_if(side) / PIECE))
    touched = stored(in_groups(met).mapInArrow(_touched(percent), "a long, b long").distinct())
    discard(dealt, *kept)

    # what may still link, in whichever blocks, comes together once: a set is sent for a cluster, not for each block
    cluster = stored(components(touched).select(F.col("node").alias("rep"), F.col("component").alias("cluster")))
    sized = cluster.join(classes.select("rep", "node", "check", "n", "point"), "rep").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sets = whole_sets(read, cluster.select("rep"), k, shared).withColumnRenamed("doc_id", "rep")
    size = lambda side: F.greatest(F.ceil(F.count_if(side) / (2 * PIECE)), F.ceil(F.sum(F.when(side, F.col("n"))) / PIECE_SHINGLES))
    met, *kept = _meeting(sized, "cluster", size, lambda rows: rows.join(sets, ["rep", "node", "check"]).drop("node", "check"))
    second = stored(in_groups(met).mapInArrow(_joined_up(percent), "a long, b long").distinct())
    discard(touched, cluster, *kept)
    found = components(first.union(second)).select(F.col("node").alias("rep"), "component")

    of_node = classes.join(found, "rep", "left").select("node", "check", F.coalesce("component", "rep").alias("component_id"))
    linked = full.select("doc_id", "n", "node", "check").join(of_node, ["node", "check"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = names.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = stored(linked.union(alone))
    discard(names, classes, first, second)
    return out


def _meeting(rows: DataFrame, group: str, pieces: Callable[[Column], Column], whole: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, ...]:
    """Rows (``group``, rep, component, ...) with the deals in which any two of a group that differ in component meet; then the stored tables that they read.

    The members of a group's largest component, its lead, needn't meet each other. They and the
    others are cut into pieces of their own, as many as ``pieces`` says for a side, so a piece of the lead meets each piece of the
    others, and those meet each other: where nearly all belong to the lead, nearly all are sent
    once. Groups of one component have no deals: they are neither made ``whole`` nor stored.
    """
    tally = rows.groupBy(group, "component").count()
    lead = stored(tally.groupBy(group).agg(F.max_by("component", F.struct("count", "component")).alias("lead"), F.count("*").alias("kinds")).where("kinds > 1").select(group, "lead"))
    rows = held = stored(whole(rows.join(small(lead), group).withColumn("led", F.col("component") == F.col("lead")).drop("lead")))
    sides = rows.groupBy(F.col(group).alias("_group")).agg(pieces(F.col("led")).alias("leads"), pieces(~F.col("led")).alias("others"))
    sized = stored(sides)
    sides = small(sized)
    rows = rows.join(sides, F.col(group) == F.col("_group"))
    piece = F.pmod(F.xxhash64("rep"), F.when(F.col("led"), F.col("leads")).otherwise(F.col("others")))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    deal = lambda a, b: F.struct(a.alias("p"), b.alias("q"))
    with_lead = F.transform(each("leads"), lambda p: deal(p, F.col("piece")))
    # with one piece of each, the others meet in the lead's deal
    among = F.when((F.col("leads") == 1) & (F.col("others") == 1), F.array().cast("array<struct<p:bigint,q:bigint>>")).otherwise(
        F.transform(each("others"), lambda p: deal(-1 - F.least("piece", p), F.greatest("piece", p)))
    )
    dealt = F.when(F.col("led"), F.transform(each("others"), lambda q: deal(F.col("piece"), q))).otherwise(F.concat(with_lead, among))
    out = rows.withColumn("piece", piece).withColumn("d", F.explode(dealt))
    return out.withColumn("deal", F.xxhash64(group, "d.p", "d.q")).drop("d", "piece", "led", "leads", "others", "_group", group), lead, held, sized
