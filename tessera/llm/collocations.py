"""Phrases that hold together more than their parts: n-gram counts by pivot partitioning, scored by their weakest cut.

Each n-gram belongs to its rarest word, the pivot. A text is rewritten for the pivot of each place:
its neighbours as far as they are more frequent, four words at most to each side. These fragments go
to the pivot's group, which counts the n-grams that the pivot owns and nothing else; frequent pivots
have a group for each word beside them, which owns the n-grams that hold both. How rare a word is
comes from a table of fixed size (``BUCKETS`` sums of counts by hash), so that what tasks share doesn't
grow with the vocabulary; any order of words gives the same counts, and all counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .textops import FACTORS, chunks, column_bytes, give_back, spread, utf8, word_hashes

#: Sums of counts that say how frequent a word is at most: 2 to this power, one byte each in a task.
BUCKET_BITS = 21
#: Occurrences of a pivot beyond which its fragments are dealt by the word beside it, and beyond which
#: those groups are dealt out further, so that their counts have to be added up.
SPLIT = 50_000
SPLIT_AGAIN = 10_000_000
#: Bytes of text, and rows of fragments, that a task handles at a time; a group of more rows is counted in parts.
TEXT_BYTES = 2 << 20
BLOCK_ROWS = 100_000
GROUP_ROWS = 500_000

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = np.array([10 if i in _PIECE_ENDS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def _bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in texts where blanks are spaces and line breaks, and the words of each text."""
    blank = (data == 32) | (data == 10)
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    starts = np.flatnonzero(~blank & (cut[:-1] | np.concatenate([[True], blank[:-1]])))
    ends = np.flatnonzero(~blank & (cut[1:] | np.concatenate([blank[1:], [True]]))) + 1
    return starts, ends, np.diff(np.searchsorted(starts, edges))


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings between ``starts`` and ``ends``."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    held = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])


def _coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each string, and the strings by code."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class _Chunk:
    """The words of a batch of texts: codes, bounds, whether each goes on the piece of the one before, and hashes by language."""

    def __init__(self, batch: pa.RecordBatch):
        raw, edges = column_bytes(batch.column("text"))
        self.data = _PLAIN[raw]
        self.starts, self.ends, sizes = _bounds(self.data, edges)
        self.codes, self.words = _coded(_slices(self.data, self.starts, self.ends))
        langs, self.langs = _coded(batch.column("lang"))
        self.lang = np.repeat(langs, sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        piece = np.cumsum(self.data == 10)[self.starts] if len(self.starts) else text
        self.goes_on = np.zeros(len(text), bool)
        self.goes_on[1:] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
        salts = np.array([xxhash.xxh3_64_intdigest(utf8(lang)) for lang in self.langs.to_pylist()], np.uint64)
        self.hashes = spread(word_hashes(*column_bytes(self.words))[0][self.codes] ^ salts[self.lang]) if len(text) else np.empty(0, np.uint64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language with their bucket and count, summed within a chunk."""
    for batch in chunks(batches, TEXT_BYTES):
        chunk = _Chunk(batch)
        _, at, n = np.unique(chunk.lang * len(chunk.words) + chunk.codes, return_index=True, return_counts=True)
        columns = [chunk.langs.take(pa.array(chunk.lang[at])), chunk.words.take(pa.array(chunk.codes[at])), pa.array(_bucket(chunk.hashes[at])), pa.array(n)]
        yield pa.record_batch([c.cast(k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "word", "bucket", "n"])


def _levels(words: DataFrame) -> np.ndarray:
    """For each bucket a byte that grows with the sum of its words' counts, four steps for a doubling; 0 where no word is frequent."""
    sums = words.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2 ** BUCKET_BITS rows at most
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    out[sums["bucket"].to_numpy()] = 1 + np.floor(4 * np.log2(sums["n"].to_numpy().astype(np.float64))).astype(np.uint8)
    return out


def _shifted(values: np.ndarray, by: int, fill: int) -> np.ndarray:
    """``values[i + by]`` at place i."""
    out = np.full(len(values), fill, values.dtype)
    if by >= 0:
        out[: len(values) - by] = values[by:]
    else:
        out[-by:] = values[:by]
    return out


def _fragments(levels, longest: int) -> Callable:
    """Fragments of each place's pivot: its neighbours while they are more frequent, or as frequent and to the right."""
    reach = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, TEXT_BYTES):
            chunk = _Chunk(batch)
            level = levels.value[_bucket(chunk.hashes)]
            # small keys are frequent words; equal levels are told apart by hash
            key = ((255 - level).astype(np.uint64) << np.uint64(56)) | (chunk.hashes >> np.uint64(8))
            linked = chunk.goes_on & (level > 0) & (np.concatenate([[0], level[:-1]]) > 0)
            left, right = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            for d in range(1, min(reach, len(key) - 1) + 1):
                left += (left == d - 1) & _shifted(linked, 1 - d, 0) & (_shifted(key, -d, 0) < key)
                right += (right == d - 1) & _shifted(linked, d, 0) & (_shifted(key, d, 0) <= key)
            at = np.flatnonzero(left + right > 0)
            left, right = left[at], right[at]
            mark = spread(chunk.hashes[at] + (left * 16 + right).astype(np.uint64))
            for d in range(-reach, reach + 1):
                inside = np.flatnonzero((-d <= left) & (d <= right))
                mark[inside] += chunk.hashes[at[inside] + d] * FACTORS[d + reach]
            _, first, which = np.unique(mark, return_index=True, return_inverse=True)
            same = (left == left[first[which]]) & (right == right[first[which]]) & (chunk.lang[at] == chunk.lang[at[first[which]]])
            for d in range(-reach, reach + 1):
                inside = np.flatnonzero(same & (-d <= left) & (d <= right))
                same[inside] = chunk.codes[at[inside] + d] == chunk.codes[at[first[which[inside]]] + d]
            other = np.flatnonzero(~same)  # equal marks of unequal fragments: counted on their own
            rows = np.concatenate([first, other])
            n = np.concatenate([np.bincount(which[same], minlength=len(first)), np.ones(len(other), np.int64)])
            place, left, right, mark = at[rows], left[rows], right[rows], mark[rows]
            most = np.exp2(level[place] / 4)
            hot = most > SPLIT
            salt = mark % np.ceil(most / SPLIT_AGAIN).astype(np.uint64)
            for beside, some in ((0, ~hot), (-1, hot & (left > 0)), (1, hot & (right > 0))):
                i = np.flatnonzero(some)
                p = place[i]
                own = chunk.hashes[p] + (chunk.hashes[p + beside] * FACTORS[beside + 1] if beside else np.uint64(0))
                start = p if beside > 0 else p - left[i]
                columns = {
                    "lang": chunk.langs.take(pa.array(chunk.lang[p])).cast(pa.string()), "fragment": _spaced(chunk, start, p + right[i]).cast(pa.string()),
                    "at": pa.array((p - start).astype(np.int32)), "beside": pa.array(np.full(len(i), beside, np.int32)), "n": pa.array(n[i]),
                    "route": pa.array(spread(own + salt[i]).view(np.int64)), "whole": pa.array(most[i] <= SPLIT_AGAIN),
                }
                yield pa.record_batch(list(columns.values()), list(columns))

    return run


def _spaced(chunk: _Chunk, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words from ``first`` to ``last``, joined by single spaces."""
    sizes = chunk.ends - chunk.starts + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.empty(offsets[-1], np.uint8)
    packed[offsets[1:] - 1] = 32
    inner = np.ones(len(packed), bool)
    inner[offsets[1:] - 1] = False
    packed[inner] = chunk.data[(chunk.data != 32) & (chunk.data != 10)]
    return _slices(packed, offsets[first], offsets[last + 1] - 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by route, cut between routes, and whether each row's group is whole; one of over ``GROUP_ROWS`` rows is cut and isn't."""
    held: list[pa.RecordBatch] = []
    parted = None
    for batch in batches:
        held.append(batch)
        rows = sum(b.num_rows for b in held)
        if rows < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        route = table["route"].to_numpy()
        cut = int(np.searchsorted(route, route[-1]))
        before, parted = parted, route[-1] if rows - cut > GROUP_ROWS else parted
        cut = rows if rows - cut > GROUP_ROWS else cut
        if cut:
            yield table.slice(0, cut), table["whole"].to_numpy()[:cut] & (route[:cut] != before) & (route[:cut] != parted)
        held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, table["whole"].to_numpy() & (table["route"].to_numpy() != parted)


def _mine(least: int, longest: int) -> Callable:
    """Counts of the n-grams that hold their fragment's pivot, grown a word at a time.

    Codes are exact: an n-gram's code is made of that of the n-gram a word shorter and the word's own.
    Groups that hold all of their pivot's fragments drop what is rarer than ``least`` before growing it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for table, whole in _blocks(batches):
            table = table.combine_chunks()
            data, edges = column_bytes(table["fragment"].chunk(0))
            starts, ends, sizes = _bounds(data, edges)
            codes, words = _coded(_slices(data, starts, ends))
            langs, lang_names = _coded(table["lang"].chunk(0))
            n, beside = table["n"].to_numpy(), table["beside"].to_numpy()
            first = np.cumsum(sizes) - sizes
            pivot = first + table["at"].to_numpy()
            row = np.arange(len(sizes))
            start, end = pivot, pivot
            _, gram = np.unique(langs * len(words) + codes[pivot], return_inverse=True)
            for size in range(2, longest + 1):
                more, less = end + 1 < (first + sizes)[row], (end == pivot[row]) & (start > first[row])
                if size == 2:  # a group of two words grows from both
                    more, less = more & (beside >= 0), less & (beside <= 0)
                on, back = np.flatnonzero(more), np.flatnonzero(less)
                grown = np.concatenate([gram[on] * 2 * len(words) + codes[end[on] + 1], (gram[back] * 2 + 1) * len(words) + codes[start[back] - 1]])
                start, end, row = np.concatenate([start[on], start[back] - 1]), np.concatenate([end[on] + 1, end[back]]), np.concatenate([row[on], row[back]])
                if not len(grown):
                    break
                _, at, gram = np.unique(grown, return_index=True, return_inverse=True)
                count = np.zeros(len(at), np.int64)
                np.add.at(count, gram, n[row])
                kept = (count >= least) | ~whole[row[at]]
                shown = np.flatnonzero(kept)
                yield pa.record_batch(
                    [lang_names.take(pa.array(langs[row[at[shown]]])).cast(pa.string()), _slices(data, starts[start[at[shown]]], ends[end[at[shown]]]).cast(pa.string()), pa.array(count[shown])],
                    ["lang", "phrase", "n"],
                )
                again = np.flatnonzero(kept[gram])
                start, end, row, gram = start[again], end[again], row[again], (np.cumsum(kept) - 1)[gram[again]]
        give_back()

    return run


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n), all of them, and phrases (lang, phrase, a) of 2 to ``longest`` words that occur at least ``least`` times."""
    read = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = read.mapInArrow(_count_words, "lang string, word string, bucket long, n long")
    words = stored(counted.groupBy("lang", "word", "bucket").agg(F.sum("n").alias("n")))
    levels = docs.sparkSession.sparkContext.broadcast(_levels(words.where(F.col("n") >= least)))
    fragments = read.mapInArrow(_fragments(levels, longest), "lang string, fragment string, at int, beside int, n long, route long, whole boolean")
    mined = fragments.repartition("route").sortWithinPartitions("route").mapInArrow(_mine(least, longest), "lang string, phrase string, n long")
    return words.drop("bucket"), mined.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def ranked(words: DataFrame, phrases: DataFrame, top: int = 2000) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score) from the counts that ``phrase_counts`` gives.

    A phrase goes if one a word longer holds it and is as frequent; that covers all longer ones, since
    what they hold in between is as frequent too.
    """
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")))
    counts = words.select("lang", F.col("word").alias("part"), F.col("n").alias("count")).union(phrases.select("lang", "phrase", "a"))
    split = phrases.withColumn("words", F.split("phrase", " "))
    ends = F.array(_part(F.col("words"), 1, F.size("words") - 1), _part(F.col("words"), 2, F.size("words") - 1))
    inside = split.where(F.size("words") > 2).select("lang", "a", F.explode(ends).alias("phrase"))
    held = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most")).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "most")
    free = split.join(held, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (F.col("most") >= F.col("a")), "left_anti")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("head"), _part(F.col("words"), F.col("k") + 1, F.size("words")).alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("head"), F.col("count").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("part").alias("tail"), F.col("count").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(a as decimal(19)) * 1000 * cast(n as decimal(15))) div (cast(l as decimal(19)) * cast(r as decimal(19)))")
    scored = cuts.join(small(totals), "lang").withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return weakest.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by their weakest cut.

    Null texts have no words, and a null lang is ``und``. A cut of a phrase scores floor(1000 * a * n /
    (l * r)) in whole numbers of up to 38 digits. Of equal cuts the one after fewest words counts.
    Repeated rows count as often as they stand; an empty table, or one without frequent phrases,
    gives no rows. Other columns are ignored.
    """
    words, phrases = phrase_counts(docs, least, longest)
    return ranked(words, stored(phrases), top)
