from pyspark.sql import functions as F

from tessera.llm import quality_classifier as qc


def test_all_labelled_documents_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(qc, "FIT_ROWS", 50, raising=False)
    vectors = spark.range(1000).select(F.col("id").alias("doc_id"), F.array(*[F.rand(i).cast("float") for i in range(qc.WIDTH)]).alias("x"))
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 != 0).cast("long").alias("quality"))
    seen = []
    monkeypatch.setattr(qc, "preference_pairs", lambda good, bad, *n: seen.extend((good.count(), bad.count())) or good.select(F.col("x").alias("g"), F.col("x").alias("h")))
    qc.fit(vectors, labels)
    own = labels.where(~qc.held_out(F.col("doc_id")))
    assert seen == [own.where("quality = 1").count(), own.where("quality = 0").count()]


def test_slots_stay_small(spark, monkeypatch):
    monkeypatch.setattr(qc, "MOST_IN_SLOT", 100, raising=False)
    side = lambda n, at: spark.range(n).select((F.col("id") + at).alias("mark"), F.array(F.col("id")).alias("x"))
    pairs = qc.preference_pairs(side(4000, 0), side(20, 10_000), 20, 4000)
    assert pairs.select("g").distinct().count() > 3950 and pairs.select("h").distinct().count() == 20
    assert pairs.groupBy("h").count().agg(F.max("count")).first()[0] < 4000
