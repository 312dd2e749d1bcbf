"""Collocations against a plain count of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, longest=5, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in found.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and a >= found[lang, w[i:j]]:
                    gone.add((lang, w[i:j]))
    by_lang = {}
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            n = totals[lang]
            score, _, l, r = min((1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r, n))
    return {(lang, i): (p.decode(), -a, l, r, n, -s) for lang, x in by_lang.items() for i, (s, a, p, l, r, n) in enumerate(sorted(x)[:top], 1)}


def got(frame):
    return {(r["lang"], r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect()}


def sample():
    rng = random.Random(3)
    vocabulary = ["a", "b", "la", "é", "the", "of", "Of", "ßx", "日", "rare", *[f"w{i}" for i in range(30)]]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(120):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " \x0b"]) for w in rng.choices(vocabulary, weights, k=rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und"])))
    phrase = "New York is   a city of the, people; of the people"
    return [*rows, *[(i, phrase, "en") for i in range(200, 212)], (1, None, "en"), (None, "la " * 400, "de"), (3, "", None), (4, " .,; ", "en"), *rows[:5]]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("words", "word", "n", "a", "phrase", "part", "bucket", "fragment", "_lang", "rank"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_counts_and_scores(spark):
    rows = sample()
    for least in (2, 9):
        want = plain(rows, least)
        assert got(collocations.collocations(frame(spark, rows), least=least)) == want and len(want) > 20
    want = plain(rows, 3, longest=3, top=4)
    assert got(collocations.collocations(frame(spark, rows), least=3, longest=3, top=4)) == want


def test_hot_pivots_are_split_and_any_order_of_words_serves(spark, monkeypatch):
    rows = sample()
    monkeypatch.setattr(collocations, "SPLIT", 7)
    assert got(collocations.collocations(frame(spark, rows), least=4)) == plain(rows, 4)
    monkeypatch.setattr(collocations, "SPLIT_AGAIN", 20)
    assert got(collocations.collocations(frame(spark, rows), least=4)) == plain(rows, 4)
    monkeypatch.setattr(collocations, "_levels", lambda words: np.full(1 << collocations.BUCKET_BITS, 3, np.uint8))
    assert got(collocations.collocations(frame(spark, rows), least=4)) == plain(rows, 4)


def test_scores_beyond_64_bits(spark):
    words = spark.createDataFrame([("en", "x", 3 * 10**12 + 1), ("en", "y", 2 * 10**12 + 7), ("en", "z", 10**14)], "lang string, word string, n long")
    phrases = spark.createDataFrame([("en", "x y", 10**12 + 3), ("en", "x y z", 10**11), ("en", "y z", 10**12)], "lang string, phrase string, a long")
    n = 10**14 + 5 * 10**12 + 8
    found = {r.phrase: (r.l, r.r, r.n, r.score) for r in collocations.ranked(words, phrases).collect()}
    assert found["x y"] == (3 * 10**12 + 1, 2 * 10**12 + 7, n, 1000 * (10**12 + 3) * n // ((3 * 10**12 + 1) * (2 * 10**12 + 7)))
    assert found["x y z"] == (10**12 + 3, 10**14, n, 1000 * 10**11 * n // ((10**12 + 3) * 10**14))


def test_nothing_frequent(spark, empty, docs):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.where("doc_id < 3"), least=10**6).count() == 0


def test_blocks_are_cut_between_groups(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_ROWS", 4)
    monkeypatch.setattr(collocations, "GROUP_ROWS", 6)
    routes = [1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.record_batch([pa.array(routes[i : i + 3]), pa.array([True] * len(routes[i : i + 3]))], ["route", "whole"]) for i in range(0, len(routes), 3)]
    blocks = [(t["route"].to_pylist(), list(w)) for t, w in collocations._blocks(iter(batches))]
    assert sum((r for r, _ in blocks), []) == routes
    assert all(w == (r != 3) for rs, ws in blocks for r, w in zip(rs, ws, strict=True))
    for route in (1, 2, 4, 5):
        assert sum(route in r for r, _ in blocks) == 1
