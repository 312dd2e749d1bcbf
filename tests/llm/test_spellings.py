"""Both spellings of every listed word give one canonical form."""

from pyspark.sql import functions as F

from tessera.llm.licenses import SPELLINGS, canonical


def test_both_sides_meet(spark):
    pairs = [(a, b) for a, b in SPELLINGS.items()]
    text = lambda c: canonical(F.concat(F.lit("for "), F.col(c), F.lit(" misconduct, "), F.col(c), F.lit(" "), F.col(c)))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", text("a").alias("x"), text("b").alias("y")).collect()
    assert [r.a for r in rows if r.x != r.y] == []


def test_wilful(spark):
    texts = spark.createDataFrame([("wilful misconduct",), ("Willful  misconduct.",)], "t string").select(canonical(F.col("t")).alias("c")).collect()
    assert {r.c for r in texts} == {"willful misconduct"}
