"""Queries that write documents with faults planted by rule and list what the readers would refuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.common import write_documents
from tessera.sources.strict import parse_errors
from tessera.storage import new_folder

#: Annotations that a document holds; a fault is planted where a key is divisible by a number.
_A_DOCUMENT = 50_000


def _object(**fields: Column | str) -> Column:
    """An object's text from its fields' texts; a field whose text is null is left out."""
    each = [F.when((text := F.expr(x) if isinstance(x, str) else x).isNotNull(), F.concat(F.lit(f'"{name}":'), text)) for name, x in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))


def _problems(spark: SparkSession, at: str, form: str) -> DataFrame:
    """Rows (problem, n), without the places of the problems."""
    found = parse_errors(spark, at, form).select(F.regexp_replace(F.regexp_replace("problem", r" at \d+\+\d+", ""), r"\[\d+\]", "[]").alias("problem"))
    return found.groupBy("problem").agg(F.count("*").alias("n"))


def _faulty_coco(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    images = orders.select(
        F.lit(0).alias("section"), F.struct(F.col("o_orderkey").alias("a"), F.lit(0).alias("b")).alias("key"),
        _object(
            id="cast(o_orderkey as string)", file_name="CASE WHEN o_orderkey % 113 <> 0 THEN concat('\"', o_orderkey, '}.jpg\"') END",
            width="CASE WHEN o_orderkey % 107 = 0 THEN '\"wide\"' ELSE '640' END", height="CASE WHEN o_orderkey % 109 = 0 THEN '-1' ELSE '480' END",
        ).alias("part"),
    )
    boxes = lines.select(
        F.lit(1).alias("section"), F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")).alias("key"),
        _object(
            id="cast(l_orderkey * 10 + l_linenumber as string)", image_id="CASE WHEN l_partkey % 101 = 0 THEN concat('\"', l_orderkey, '\"') ELSE cast(l_orderkey as string) END",
            category_id="CASE WHEN l_partkey % 103 <> 0 THEN cast(l_suppkey as string) END",
            bbox="CASE WHEN l_partkey % 97 = 0 THEN '[1,2,3]' WHEN l_partkey % 83 = 0 THEN '[1,2,1e999,4]' ELSE concat('[1,2.5,', cast(l_quantity as string), ',4]') END",
            score="CASE WHEN l_suppkey % 89 = 0 THEN 'true' WHEN l_suppkey % 7 = 0 THEN 'null' END",
        ).alias("part"),
    )
    at = new_folder(spark)
    shards = 1 + lines.count() // _A_DOCUMENT
    write_documents(images.unionByName(boxes), at, shards, '{"info":{"year":2020},"categories":[{"id":1},{"id":2,"name":"x"}],"images":[', "]}", middles=('],"annotations":[',))
    # every document lists the categories
    found = _problems(spark, at, "coco")
    return found.select("problem", F.when(F.col("problem").startswith("categories"), F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"))


def _faulty_create_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = _object(x="CASE WHEN l_partkey % 97 = 0 THEN '\"1\"' ELSE '1.5' END", y="'2'", width="CASE WHEN l_partkey % 101 <> 0 THEN '3' END", height="CASE WHEN l_partkey % 103 = 0 THEN '[]' ELSE '4' END")
    note = lines.withColumn("note", _object(label="CASE WHEN l_partkey % 83 = 0 THEN '7' ELSE '\"x\"' END", coordinates=place))
    part = _object(image="concat('\"', l_orderkey, '.jpg\"')", annotations=F.concat(F.lit("["), F.col("note"), F.lit("]")))
    at = new_folder(spark)
    rows = note.select(F.struct("l_orderkey", "l_linenumber").alias("key"), part.alias("part"))
    write_documents(rows, at, 1 + lines.count() // _A_DOCUMENT, "[", "]")
    return _problems(spark, at, "create-ml")


def _counted(*cases: tuple[str, str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{problem.replace(chr(39), chr(39) * 2)}' AS problem, count(*) AS n FROM {table} WHERE {rule}" for problem, table, rule in cases)
    return f"SELECT problem, n FROM ({each}) WHERE n > 0"


def queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    coco = _counted(
        ("images.file_name is missing, not text", "orders", "o_orderkey % 113 = 0"), ("images.width isn't a count", "orders", "o_orderkey % 107 = 0"), ("images.height isn't a count", "orders", "o_orderkey % 109 = 0"),
        ("annotations.image_id isn't an id", "lineitem", "l_partkey % 101 = 0"), ("annotations.category_id is missing, not an id", "lineitem", "l_partkey % 103 = 0"),
        ("annotations.bbox isn't a list of 4", "lineitem", "l_partkey % 97 = 0"), ("annotations.bbox[] isn't a number", "lineitem", "l_partkey % 97 <> 0 AND l_partkey % 83 = 0"),
        ("annotations.score isn't a number", "lineitem", "l_suppkey % 89 = 0"), ("categories.name is missing, not text", "(SELECT 1)", "true"),
    )
    at = "$[].annotations[]"
    create_ml = _counted(
        (f"{at}.label isn't text", "lineitem", "l_partkey % 83 = 0"), (f"{at}.coordinates.x isn't a number", "lineitem", "l_partkey % 97 = 0"),
        (f"{at}.coordinates.width is missing, not a number", "lineitem", "l_partkey % 101 = 0"), (f"{at}.coordinates.height isn't a number", "lineitem", "l_partkey % 103 = 0"),
    )
    return {"parse_errors_coco": (_faulty_coco, coco), "parse_errors_create_ml": (_faulty_create_ml, create_ml)}
