"""The filter audit against a plain version."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tessera.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    rows = [(i, t or "", lang or "") for i, t, lang, *_ in rows]
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t] = min(i, low.get(t, i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    failed = []
    for i, t, part in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), i is not None and i > low[t])
        failed.append((part, i, {x for x, f in zip("ABCDE", tests, strict=True) if f}))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in failed}:
            mine = [x for x in failed if x[0] == part]
            for k, letter in enumerate(order):
                reach = [x for x in mine if not x[2] & set(order[:k])]
                gone = [x for x in reach if letter in x[2]]
                shapley[part, letter] += len(gone)
                out[part, order, k + 1] = (len(reach) - len(gone), len(gone), sum(letter in x[2] for x in mine) - len(gone), sum(x[2] == {letter} for x in mine), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


def odd_rows(rows):
    long = "x" * 3000
    more = [(900, long + "A", "de"), (901, long + "B", "de"), (902, long + "B", "de"), (903, "AB CD", None), (902, long + "B", "fr"), (904, "é" * 130, "fr"), (905, "é" * 130, "fr"), (None, "é" * 130, "fr")]
    return [*rows, *[(i, t, lang, "s", 1) for i, t, lang in more]]


def frames(spark, rows):
    docs = spark.createDataFrame(odd_rows(rows), "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60)] + [(3, 0, 1), (3, 0, 0), (902, 1, None), (None, 1, 1)]
    for name in ("part", "failed", "own", "before", "n", "step", "__low_", "quality"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs, spark.createDataFrame(labels, LABELS), labels


def test_audit(spark, rows):
    docs, labels, plain_labels = frames(spark, rows)
    want = plain(odd_rows(rows), plain_labels)
    assert got(filter_audit.audit(docs, labels)) == want
    assert len(want) == 4 * 600


def test_texts_with_equal_hashes_are_told_apart(spark, rows, monkeypatch):
    docs, labels, plain_labels = frames(spark, rows)
    monkeypatch.setattr(filter_audit, "_block_hash", lambda text, start, size: F.lit(7).cast("long"))
    assert got(filter_audit.audit(docs, labels)) == plain(odd_rows(rows), plain_labels)


def test_rounds_without_broadcasts(spark, rows, monkeypatch):
    docs, labels, plain_labels = frames(spark, rows)
    monkeypatch.setattr(filter_audit, "small", lambda df: df)
    assert got(filter_audit.audit(docs, labels)) == plain(odd_rows(rows), plain_labels)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(empty, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], empty.schema)
    counts = got(filter_audit.audit(one, labels))
    assert len(counts) == 600 and counts["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
