"""Language identification: held-out accuracy, and odd texts."""

import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id
from tessera.llm.registry import op11_language_id

SCHEMA = "doc_id long, text string, lang string"
#: Syllables of made-up languages.
SOUNDS = {"aa": ["ka", "to", "mi", "ru", "shi"], "bb": ["str", "en", "und", "ach", "keit"], "cc": ["жа", "по", "ни", "ск", "ов"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randrange(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(i, say(rng, lang := rng.choice(list(SOUNDS)), rng.randrange(10, 80)), lang) for i in range(200)]


def test_held_out_documents(spark, rows):
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert {i for i, *_ in held} == {i for i, r in out.items() if r.held_out} and len(held) > 30
    assert all(out[i].lang_pred == lang and out[i].accepted for i, _, lang in held)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_held_out_rows_change_nothing(spark, rows):
    """Languages of held-out rows aren't looked at, nor is the language of what is predicted."""
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    plain = language_id.identify(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, language_id.identify(spark.createDataFrame(other, SCHEMA)).collect()))


def test_odd_rows(spark, rows):
    rng = random.Random(9)
    long = say(rng, "bb", 30_000)
    mixed = say(rng, "aa", 40) + " " + say(rng, "bb", 40)
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !! — …", "bb"), (1003, long, None), (None, say(rng, "cc", 40), "cc"), (1004, mixed, None), (1004, mixed, None), (1005, "x" * 20_000, None), (1006, say(rng, "aa", 50).upper(), None)]
    frame = spark.createDataFrame([*rows, *odd], SCHEMA)
    for name in ("score", "held_out", "lettered", "_lang", "_draw", "place", "passage", "count"):
        frame = frame.withColumn(name, F.lit("x"))
    out = language_id.identify(frame).where("doc_id is null or doc_id >= 1000").collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(odd)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000].score == 0.0
    assert by_id[1003].lang_pred == "bb" and by_id[None].lang_pred == "cc" and not by_id[None].held_out and by_id[1006].lang_pred == "aa"
    assert by_id[1004].score < by_id[1003].score and by_id[1005].lang_pred in SOUNDS


def test_empty_tables_and_one_language(spark, rows, empty):
    assert language_id.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(i, t, None) for i, t, _ in rows[:5]], SCHEMA)
    assert {(r.lang_pred, r.score, r.accepted) for r in language_id.identify(unlabelled).collect()} == {("und", 0.0, False)}
    only = spark.createDataFrame([x for x in rows if x[2] == "bb"], SCHEMA)
    assert {r.lang_pred for r in language_id.identify(only).collect()} == {"bb"}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.dictionaries(spark.createDataFrame([(i, f"word{i}", f"l{i}") for i in range(12)], SCHEMA))


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the driver's tables")
def test_accuracy_on_the_tables(spark):
    at = "/root/testdata/sf0.01"
    both = op11_language_id(spark, at).join(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = both.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n >= 0.97
