"""Language-model scoring by prediction by partial matching over bytes.

Training texts (lower-cased, words joined by single spaces, an end mark) are counted as runs of
``ORDER`` bytes and the byte that follows. The counts of shorter contexts follow by summing, and
together they are the context trie: each context knows the symbols seen after it. A byte's
probability starts at its longest known context. There the byte has its share of the counts, or
escapes to the next shorter context, where symbols that the longer one could have coded are
left out (symbol exclusion). The chance of an escape follows the number of distinct symbols
(method C). Below the empty context all remaining byte values are alike.

No run is left out, however rare. Each run of the documents gets its probability once, in tasks
that hold all runs which share the two bytes before the last, and so their whole part of the
trie below the two shortest orders. The most frequent runs are sent to all tasks; the others are
joined to the documents that hold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textops import Tally, chunks, joined, single_spaced, word_hashes

#: Bytes of context; with the byte that follows they fit a 64-bit key.
ORDER = 5
#: The byte that marks an end of text; it isn't part of UTF-8.
END = 0xFF
#: Runs of bytes, and words of the plain base model, sent to all tasks at most; the others are joined.
TRIE, COMMON = 1 << 20, 1 << 21
#: Bytes of text scored at a time.
CHUNK = 1 << 20
#: The hash that stands for the end of a text among words.
END_WORD = np.uint64(0x517CC1B727220A95)


def _mask(n: int) -> int:
    return (1 << 8 * n) - 1


def _lines(column: pa.Array) -> list[bytes]:
    return [single_spaced(x.lower()) if x else b"" for x in column.cast(pa.binary()).to_pylist()]


def _stream(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all symbols of the texts, ``ORDER`` bytes and the symbol, and each text's number of symbols."""
    pad, end = bytes([END]) * ORDER, bytes([END])
    sizes = np.fromiter((len(p) + 1 for p in lines), np.int64, len(lines))
    data = np.frombuffer(pad + (end + pad).join(lines) + end, np.uint8).astype(np.uint64)
    key = np.zeros(len(data) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        key = (key << np.uint64(8)) | data[j : len(data) - ORDER + j]
    # drop the symbols that are padding
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)) * ORDER, sizes)
    return key[at], sizes


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): byte runs (kind 0) and word hashes (kind 1) of the training texts, byte runs of the others (kind 2)."""
    tallies = (Tally(), Tally(), Tally())

    def out(kind: int, tally: Tally) -> pa.RecordBatch:
        keys, n = tally.take()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    for b in chunks(batches, CHUNK):
        every, learnt = _lines(b.column("text")), b.column("learnt").to_pylist()
        lines = [x for x, y in zip(every, learnt, strict=True) if y]
        if lines:
            tallies[0].add(_stream(lines)[0])
            tallies[1].add(np.concatenate([word_hashes(*joined(lines))[0], np.full(len(lines), END_WORD)]))
        if len(lines) < len(every):
            tallies[2].add(_stream([x for x, y in zip(every, learnt, strict=True) if not y])[0])
        for kind, tally in enumerate(tallies):
            if tally.full():
                yield out(kind, tally)
    for kind, tally in enumerate(tallies):
        yield out(kind, tally)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class Trie:
    """The contexts of each order as sorted arrays, and the probabilities they give."""

    def __init__(self, levels: list[dict[str, np.ndarray]]):
        self.levels = levels

    @staticmethod
    def of(grams: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        """From (key, n) of the runs of each length, in order of the keys; a context's runs must all be there."""
        levels = []
        for j, (key, n) in enumerate(grams):
            own = key >> np.uint64(8) if j else np.zeros(len(key), np.uint64)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
            level = {"key": key, "n": n.astype(np.float64), "ctx": own[first]}
            level["total"] = np.add.reduceat(level["n"], first) if len(first) else np.empty(0)
            level["kinds"] = np.diff(np.concatenate([first, [len(key)]])).astype(np.float64)
            # what the next shorter context counts for the symbols seen here
            level["shut"] = np.zeros(len(first))
            if j and len(first):
                below = levels[j - 1]
                level["shut"] = np.add.reduceat(below["n"][np.searchsorted(below["key"], key & np.uint64(_mask(j)))], first)
            levels.append(level)
        return Trie(levels)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of the last byte of each key after the bytes before it."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        shut, shut_size = np.zeros(len(keys)), np.zeros(len(keys))
        for j in range(ORDER, -1, -1):
            level = self.levels[j]
            if not len(left) or not len(level["ctx"]):
                continue
            q = keys[left]
            ctx = (q >> np.uint64(8)) & np.uint64(_mask(j))
            at = np.minimum(np.searchsorted(level["ctx"], ctx), len(level["ctx"]) - 1)
            known = level["ctx"][at] == ctx
            here, at = left[known], at[known]
            run = q[known] & np.uint64(_mask(j + 1))
            g = np.minimum(np.searchsorted(level["key"], run), len(level["key"]) - 1)
            hit = level["key"][g] == run
            rest = level["total"][at] - shut[here]
            escape = np.where(level["kinds"][at] >= 256, 0.0, np.maximum(level["kinds"][at] - shut_size[here], 1.0))
            out[here] += np.log10(np.where(hit, level["n"][g], escape) / (rest + escape))
            shut[here], shut_size[here] = level["shut"][at], level["kinds"][at]
            gone = np.zeros(len(left), bool)
            gone[np.flatnonzero(known)[hit]] = True
            left = left[~gone]
        out[left] -= np.log10(256 - shut_size[left])
        return out


def _pair(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(8)) & np.uint64(0xFFFF)


def _logs(short):
    """Rows (key, seen, log) from rows (key, n, seen) in which the runs of a pair (see ``_pair``) are in one piece."""

    def done(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, n, seen = (np.concatenate(c) for c in zip(*parts, strict=True))
        learnt = n > 0
        grams = list(short.value)
        grams += [_summed(key[learnt] & np.uint64(_mask(j + 1)), n[learnt]) for j in range(2, ORDER + 1)]
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(seen), pa.array(Trie.of(grams).log10(key))], ["key", "seen", "log"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = np.asarray(b.column("key")).view(np.uint64), np.asarray(b.column("n")), np.asarray(b.column("seen"))
            pair = _pair(now[0])
            # a pair may go on in the next batch: all before the last one is whole
            cut = int(np.flatnonzero(pair != pair[-1])[-1]) + 1 if pair[0] != pair[-1] else 0
            if not cut and held and _pair(held[-1][0][-1:])[0] != pair[0]:
                yield done(held)
                held = []
            if cut:
                yield done([*held, tuple(x[:cut] for x in now)])
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield done(held)

    return run


class Model:
    """The counts of all runs (key, n, seen) as a table, and the probabilities they give."""

    def __init__(self, runs: DataFrame):
        self.runs = runs

    def logs(self) -> DataFrame:
        """Rows (key, seen, log): the log10 probability of each run's last byte after the bytes before it."""
        short = []
        for j in (0, 1):  # at most 256 and 65,536 rows
            got = self.runs.where("n > 0").groupBy(F.col("key").bitwiseAND(_mask(j + 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
            short.append(_summed(np.asarray(got.column("key").combine_chunks()).astype(np.int64).view(np.uint64), np.asarray(got.column("n").combine_chunks()).astype(np.int64)))
        pair = F.shiftright("key", 8).bitwiseAND(0xFFFF)
        dealt = self.runs.repartition(pair).sortWithinPartitions(pair)
        return dealt.mapInArrow(_logs(self.runs.sparkSession.sparkContext.broadcast(short)), "key long, seen long, log double")

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of the last byte of each of a few distinct keys."""
        asked = self.runs.sparkSession.createDataFrame([(int(k),) for k in keys], "key long")
        runs = self.runs.select("key", "n", F.lit(0).cast("long").alias("seen")).union(asked.select("key", F.lit(0).cast("long"), F.lit(1).cast("long")))
        runs = runs.groupBy("key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
        got = {r.key: r.log for r in Model(runs).logs().where("seen > 0").collect()}
        return np.array([got[int(k)] for k in keys])


def learn(docs: DataFrame, training: Column | None = None) -> tuple[Model, dict]:
    """The model of the runs and the base model of the training texts in ``docs``: common words, all words (as a table) and totals."""
    learnt = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    counts = docs.select("text", learnt.alias("learnt")).mapInArrow(_learn, "kind int, key long, n long")
    counts = stored(counts.groupBy((F.col("kind") % 2).alias("of"), "key").agg(F.sum(F.when(F.col("kind") < 2, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("seen")))
    words = counts.where("of = 1").select("key", "n")
    tokens, kinds = words.agg(F.sum("n"), F.count("*")).first()
    tokens, kinds = tokens or 0, kinds or 0
    got = words.where(F.col("n") >= max(1, tokens // COMMON)).toArrow()
    key, n = np.asarray(got.column("key").combine_chunks()).astype(np.int64).view(np.uint64), np.asarray(got.column("n").combine_chunks())
    order = np.argsort(key)
    base = {"common": (key[order], n[order].astype(np.float64)), "rare": words.where(F.col("n") < max(1, tokens // COMMON)), "tokens": tokens, "kinds": kinds}
    return Model(counts.where("of = 0").select("key", "n", "seen")), base


def _parted(logs: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """The at most ``TRIE`` most frequent runs and their logs as arrays, and the table of the others."""
    step = F.floor(F.log2("seen") * 16)
    least, held = 1 << 62, 0
    for r in sorted(logs.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > TRIE:
            break
        least = r["step"]
    got = logs.where(step >= least).select("key", "log").toArrow()
    key, log = np.asarray(got.column("key").combine_chunks()).astype(np.int64).view(np.uint64), np.asarray(got.column("log").combine_chunks())
    order = np.argsort(key)
    return (key[order], log[order]), logs.where(step < least).select("key", "log")


_SCORED = "row long, doc_id long, n_tokens long, n_known long, logs double, score double, word array<long>, times array<long>, run array<long>, run_times array<long>"


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, log, common, weight = model.value
        row = TaskContext.get().partitionId() << 33
        for b in chunks(batches, CHUNK):
            if not b.num_rows:
                continue
            lines = _lines(b.column("text"))
            keys, sizes = _stream(lines)
            kinds, back = np.unique(keys, return_inverse=True)
            at = np.minimum(np.searchsorted(frequent, kinds), max(0, len(frequent) - 1))
            met = frequent[at] == kinds if len(frequent) else np.zeros(len(kinds), bool)
            value = np.where(met, log[at], 0.0) if len(frequent) else np.zeros(len(kinds))
            score = np.add.reduceat(value[back], np.cumsum(sizes) - sizes)
            # the other runs of each text, once, with how often it has them
            rest = np.flatnonzero(~met[back])
            run_of, run_times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[rest] * len(kinds) + back[rest], return_counts=True)
            bounds = np.searchsorted(run_of, np.arange(len(sizes) + 1) * len(kinds)).astype(np.int32)
            run = kinds[run_of % len(kinds)].view(np.int64)
            h, _, _, first = word_hashes(*joined(lines))
            h = np.insert(h, first[1:], END_WORD)
            n = np.diff(first) + 1
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                hit = common[at] == h
                logs = np.where(hit, weight[at], 0.0)
            else:
                hit, logs = np.zeros(len(h), bool), np.zeros(len(h))
            first = np.cumsum(n) - n
            words, times = [], []
            for s, m in zip(first.tolist(), n.tolist(), strict=True):
                w, t = np.unique(h[s : s + m][~hit[s : s + m]], return_counts=True)
                words.append(w.view(np.int64)), times.append(t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(n))), b.column("doc_id"), pa.array(n), pa.array(np.add.reduceat(hit.astype(np.int64), first)),
                    pa.array(np.add.reduceat(logs, first)), pa.array(score), pa.array(words, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(bounds, pa.array(run)), pa.ListArray.from_arrays(bounds, pa.array(run_times)),
                ],
                ["row", "doc_id", "n_tokens", "n_known", "logs", "score", "word", "times", "run", "run_times"],
            )
            row += len(n)

    return run


def in_turn(doc_id: Column, turn: int) -> Column:
    """Whether crc32 of the id as text leaves ``turn`` when divided by 5; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == turn, F.lit(False))


def score(docs: DataFrame, training: Column) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score), one for each document.

    ``training`` picks the documents to learn from. ``score`` is the log10 probability of the
    lower-cased text, blanks as single spaces, and of its end. Null texts are empty: their end
    alone is scored. Words are told apart by 64-bit hashes. Common words and frequent runs are
    looked up in place; the others' counts and probabilities are joined to the documents' rare ones.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs, base = learn(docs, training)
    (frequent, log), rare = _parted(stored(runs.logs()))
    below = math.log10(base["tokens"] + 0.5 * (base["kinds"] + 1))
    common, n = base["common"]
    model = docs.sparkSession.sparkContext.broadcast((frequent, log, common, np.log10(n + 0.5)))
    scored = stored(read.mapInArrow(_score(model), _SCORED))
    pairs = scored.select("row", F.explode(F.arrays_zip("word", "times")).alias("p")).select("row", F.col("p.word").alias("key"), F.col("p.times").alias("times"))
    known = pairs.join(base["rare"], "key", "left")
    of_words = known.select("row", (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("met"), F.lit(0.0).alias("runs"))
    pairs = scored.select("row", F.explode(F.arrays_zip("run", "run_times")).alias("p")).select("row", F.col("p.run").alias("key"), F.col("p.run_times").alias("times"))
    of_runs = pairs.join(rare, "key").select("row", F.lit(0.0), F.lit(0).cast("long"), F.col("times") * F.col("log"))
    more = of_words.union(of_runs).groupBy("row").agg(F.sum("more").alias("more"), F.sum("met").alias("met"), F.sum("runs").alias("runs"))
    joined = scored.drop("word", "times", "run", "run_times").join(more, "row", "left")
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(base["tokens"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("score") + F.coalesce("runs", F.lit(0.0))).alias("score"),
    )
