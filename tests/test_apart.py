from pyspark.sql import functions as F

from tessera.model import dataset
from tessera.operators import sample


def test_large_tables_are_joined_in_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(sample, "ROWS_A_TASK", 1000, raising=False)
    images = spark.range(9000).select("id", F.concat("id", F.lit(".jpg")).alias("file_name"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.col("id").alias("_ord"))
    categories = spark.createDataFrame([(k, f"c{k}", k) for k in range(3)], "id long, name string, _ord long")
    annotations = spark.range(18000).select("id", (F.col("id") % 10000).alias("image_id"), (F.col("id") % 3).alias("category_id"), F.col("id").alias("_ord"))
    out = sample.filter_categories(dataset(images, categories, annotations), ["c1"])
    kept = {n % 10000 for n in range(18000) if n % 3 == 1 and n % 10000 < 9000}
    assert {r.id for r in out.images.collect()} == kept
    assert sorted(r.id for r in out.annotations.collect()) == [n for n in range(18000) if n % 10000 in kept]
    plan = out.annotations._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Join Inner") < plan.find("RepartitionByExpression [image_id") and ", 18" in plan
