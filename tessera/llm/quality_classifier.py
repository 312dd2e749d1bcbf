"""A quality classifier: Bradley-Terry ranking of documents from preference pairs.

Documents become vectors of features of their whole text: surface counts, and the shares of its
words and of its runs of three bytes in hashed buckets. In a preference pair one
document is marked good and the other bad; the chance that the good one is preferred is the
logistic function of the difference of their scores, and the weights minimise the logistic
loss on the feature differences (Newton steps, gradients and curvatures summed by Spark). The
ranking becomes a probability-like score by a quantile: documents ranked below the share of bad
labels get less than ``CUT``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .textops import utf8

#: A score of this or more predicts label 1.
CUT = 0.3
#: Pairs made of each document at least, and documents of the rarer label in a slot, about.
PAIRS_EACH, SLOT_ROWS = 4, 8
#: Slots that are made in any case where there are documents enough, and documents of the commoner label in a slot beyond them.
SLOTS, MOST_IN_SLOT = 125, 10_000
#: Newton steps, and the weight of the squared norm that keeps separable data finite.
STEPS, RIDGE = 12, 1e-3
#: Features of a text, each within 0 and 1 or a logarithm.
FEATURES = (
    "log_words", "word_length", "upper_words", "upper_letters", "digits", "symbols", "bangs", "bars", "marks", "distinct_words",
    "common_word", "repeat_pairs", "dup_lines", "words_per_line", "sentence_length", "long_words", "links", "braces", "ends_abrupt", "richness",
)
#: Buckets of words and of runs of three bytes.
WORD_BUCKETS, BYTE_BUCKETS = 64, 64
WIDTH = len(FEATURES) + WORD_BUCKETS + BYTE_BUCKETS


def features(text: str | None) -> list[float]:
    """The features of one whole text; null and blank texts give zeros throughout."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * WIDTH
    size = len(raw)
    kinds = Counter(words)
    pairs = n - len(set(zip(words, words[1:], strict=False))) - 1 if n > 1 else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    count = lambda marks: size - len(raw.translate(None, marks))
    ends = count(b".!?")
    shouting = sum(c for w, c in kinds.items() if len(w) > 1 and w.isupper())
    long_words = sum(c for w, c in kinds.items() if len(w) > 20)
    # roots of shares: frequent words and runs don't outweigh all others
    in_words = np.bincount([crc32(w) % WORD_BUCKETS for w in kinds], list(kinds.values()), WORD_BUCKETS)
    code = np.frombuffer(raw, np.uint8).astype(np.uint32)
    runs = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(26)
    in_runs = np.bincount(runs, minlength=BYTE_BUCKETS)
    return [
        math.log1p(n) / 10,
        min(1.0, (size - count(b" \t\n\x0b\x0c\r")) / n / 20),
        shouting / n,
        upper / max(1, letters),
        count(b"0123456789") / size,
        min(1.0, count(b"#*$%&|<>") / n),
        min(1.0, raw.count(b"!!") / n),
        min(1.0, raw.count(b" | ") / n),
        min(1.0, count(b"!?;:_~^=+@/\\\"'()[]-") / n),
        len(kinds) / n,
        max(kinds.values()) / n,
        max(0, pairs) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, n / max(1, len(lines)) / 100),
        min(1.0, n / max(1, ends) / 100),
        long_words / n,
        min(1.0, raw.count(b"http") / n * 10),
        min(1.0, count(b"{}<>") / n),
        float(raw.rstrip()[-1:] not in (b".", b"!", b"?", b'"')),
        math.log1p(len(kinds)) / math.log1p(n),
        *np.sqrt(in_words / n),
        *np.sqrt(in_runs / size),
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.array([features(t) for t in b.column("text").to_pylist()], np.float32).reshape(b.num_rows, WIDTH)
        arr = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), arr], ["doc_id", "x"])


def _newton_part(w: np.ndarray):
    """Sums of one task for a Newton step: loss, gradient and curvature over its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w)
        loss, grad, curve, n = 0.0, np.zeros(k), np.zeros((k, k)), 0
        for b in batches:
            if not b.num_rows:
                continue
            d = np.array(b.column("g").flatten(), np.float64).reshape(-1, k) - np.array(b.column("h").flatten(), np.float64).reshape(-1, k)
            m = d @ w
            p = 1 / (1 + np.exp(np.clip(m, -500, 500)))
            loss += np.logaddexp(0, -m).sum()
            grad -= d.T @ p
            curve += (d * (p * (1 - p))[:, None]).T @ d
            n += len(d)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n, loss], grad, curve.ravel()]).tolist()])], ["sums"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def preference_pairs(good: DataFrame, bad: DataFrame, few: int, many: int = 0) -> DataFrame:
    """Rows (g, h), the features of a good and of a bad document, from rows (mark, x) of each kind; ``few`` is the smaller count, ``many`` the larger.

    Both sides are dealt to the same slots by hash, ``PAIRS_EACH`` times; within a slot, turns pair
    them up, so each counts alike and no document meets all of the other side. Slots grow in number with the
    commoner side, so they don't grow in size; the rarer side is then dealt often enough to reach them all.
    """
    slots = max(1, min(few // SLOT_ROWS, SLOTS), PAIRS_EACH * many // MOST_IN_SLOT)
    often = max(PAIRS_EACH, -(-SLOT_ROWS * slots // max(1, few)))
    rare = "h" if many and bad.count() <= few else "g"

    def dealt(side: DataFrame, name: str, turns: int) -> DataFrame:
        slot = F.explode(F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda t: F.pmod(F.xxhash64("mark", t), F.lit(slots))))
        return side.select(F.col("x").alias(name), F.col("mark").alias(f"m_{name}"), slot.alias("slot"))

    ranked = {}
    for side, name in ((good, "g"), (bad, "h")):
        d = dealt(side, name, often if name == rare else PAIRS_EACH)
        ranked[name] = d.withColumn("at", F.row_number().over(Window.partitionBy("slot").orderBy(f"m_{name}")))
    sizes = {name: d.groupBy("slot").agg(F.max("at").alias(f"n_{name}")) for name, d in ranked.items()}
    both = sizes["g"].join(sizes["h"], "slot")
    g = ranked["g"].join(both, "slot")
    # the shorter side of a slot goes round again until each of the longer has met one
    g = g.withColumn("turn", F.explode(F.sequence(F.col("at"), F.greatest("n_g", "n_h"), F.col("n_g")))).select("slot", "turn", "g")
    h = ranked["h"].join(both, "slot").withColumn("turn", F.explode(F.sequence(F.col("at"), F.greatest("n_g", "n_h"), F.col("n_h")))).select("slot", "turn", "h")
    return g.join(h, ["slot", "turn"]).select("g", "h")


def newton(pairs: DataFrame, k: int) -> np.ndarray:
    """The weights that minimise the mean logistic loss on feature differences, plus ``RIDGE`` times half their squared norm."""
    w = np.zeros(k)
    for _ in range(STEPS):
        parts = pairs.mapInArrow(_newton_part(w), "sums array<double>")
        rows = parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros(2 + k + k * k)
        for r in rows:
            sums[r["i"]] = r["v"]
        n, grad, curve = max(1.0, sums[0]), sums[2 : 2 + k], sums[2 + k :].reshape(k, k)
        step = np.linalg.solve(curve / n + RIDGE * np.eye(k), grad / n + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-6 * (1 + np.abs(w).max()):
            break
    return w


def fit(vectors: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float]:
    """Weights, the raw score at the quantile, and a scale, from all labelled vectors (doc_id, x) and their labels (doc_id, quality)."""
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked.where(~held_out(F.col("doc_id")))
    rows = marked.join(vectors, "doc_id").dropDuplicates(["doc_id"]).select("quality", "x", F.xxhash64("doc_id").alias("mark"))
    rows = stored(rows)
    good, bad = (rows.where(F.col("quality") == label).select("mark", "x") for label in (1, 0))
    n_good, n_bad = good.count(), bad.count()
    if not n_good or not n_bad:
        return np.zeros(WIDTH), 0.0, 1.0
    w = newton(stored(preference_pairs(good, bad, min(n_good, n_bad), max(n_good, n_bad))), WIDTH)
    raw = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = good.select(raw.alias("s"), F.lit(1).alias("y")).union(bad.select(raw.alias("s"), F.lit(0).alias("y")))
    share = n_bad / (n_good + n_bad)
    cut, lo, hi = scored.agg(F.percentile_approx("s", [share, share / 2, (1 + share) / 2], 10_000)).first()[0]
    return w, float(cut), max(1e-6, (hi - lo) / 6)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each document.

    Labels other than 0 and 1, null ids and repeated labels are taken care of: a document labelled
    both ways counts as bad. Empty and null texts get the score of all-zero features, equal texts equal
    scores, repeated rows their own row each. Without labels of both kinds every score is ``CUT``;
    an empty table gives no rows.
    """
    vectors = stored(docs.select("doc_id", "text").mapInArrow(_featured, "doc_id long, x array<float>"))
    w, cut, scale = fit(vectors, labels.select("doc_id", "quality"))
    raw = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    score = 1 / (1 + F.exp(-((raw - cut) / scale + math.log(CUT / (1 - CUT)))))
    out = vectors.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
