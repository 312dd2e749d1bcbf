"""The canonical model derived from order tables: orders are images, suppliers categories, line items boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import AnnotationDataset, dataset


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, changed: bool = False) -> AnnotationDataset:
    """The dataset of a folder of tables; ``changed`` gives its second version for comparisons."""
    orders, lines = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    suppliers, nations = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    if changed:
        orders, lines = orders.where("o_orderkey % 53 <> 0"), lines.where("l_partkey % 37 <> 0")
    images = orders.where("o_orderkey % 101 <> 0").selectExpr(
        "o_orderkey AS id", "concat('img_', lpad(cast(o_orderkey AS string), 8, '0'), '.jpg') AS file_name",
        "CASE WHEN o_orderkey % 211 = 0 THEN 0 ELSE 320 + (o_orderkey * 37) % 1601 END AS width", "240 + (o_orderkey * 53) % 841 AS height",
        "CASE WHEN o_orderstatus = 'P' THEN date_format(o_orderdate, 'yyyy-MM-dd') END AS date_captured", "o_orderkey AS _ord",
    )
    categories = suppliers.where("s_suppkey % 17 <> 0").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left").selectExpr(
        "s_suppkey AS id", "concat('cls_', lpad(cast(s_suppkey % 60 AS string), 3, '0')) AS name", "n_name AS supercategory", "s_suppkey AS _ord"
    )
    shift, step = ("CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END", "CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END") if changed else ("0", "0")
    annotations = lines.selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS image_id", f"l_suppkey + {step} AS category_id",
        f"cast((l_partkey * 7) % 1500 AS double) + {shift} AS xmin", "cast((l_partkey * 11) % 900 AS double) AS ymin",
        f"cast((l_partkey * 7) % 1500 AS double) + CASE WHEN l_partkey % 83 = 0 THEN -1 ELSE 1 END * l_quantity * 4 + {shift} AS xmax",
        "cast((l_partkey * 11) % 900 AS double) + CASE WHEN l_partkey % 89 = 0 THEN 0 ELSE 1 END * l_quantity * l_linenumber AS ymax",
        "CASE WHEN l_returnflag = 'R' THEN 1 - l_discount END AS confidence",
        "CASE WHEN l_linestatus = 'O' AND l_linenumber > 2 THEN map('occluded', '1') WHEN l_returnflag = 'A' THEN map('iscrowd', '1') ELSE cast(map() AS map<string,string>) END AS attributes",
        # the place in the source, as a value that sorts; no task sees all rows to number them
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS _ord",
    )
    return dataset(images, categories, annotations)


IMAGES = """SELECT o_orderkey AS id, concat('img_', lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), '.jpg') AS file_name,
  CAST(CASE WHEN o_orderkey % 211 = 0 THEN 0 ELSE 320 + (o_orderkey * 37) % 1601 END AS BIGINT) AS width, CAST(240 + (o_orderkey * 53) % 841 AS BIGINT) AS height,
  CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_captured
  FROM orders WHERE o_orderkey % 101 <> 0"""
CATEGORIES = """SELECT s_suppkey AS id, concat('cls_', lpad(CAST(s_suppkey % 60 AS VARCHAR), 3, '0')) AS name, n_name AS supercategory
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 17 <> 0"""
ANNOTATIONS = """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, l_suppkey AS category_id,
  CAST((l_partkey * 7) % 1500 AS DOUBLE) AS xmin, CAST((l_partkey * 11) % 900 AS DOUBLE) AS ymin,
  CAST((l_partkey * 7) % 1500 AS DOUBLE) + CASE WHEN l_partkey % 83 = 0 THEN -1 ELSE 1 END * l_quantity * 4 AS xmax,
  CAST((l_partkey * 11) % 900 AS DOUBLE) + CASE WHEN l_partkey % 89 = 0 THEN 0 ELSE 1 END * l_quantity * l_linenumber AS ymax,
  CASE WHEN l_returnflag = 'R' THEN 1 - l_discount END AS confidence,
  CASE WHEN l_linestatus = 'O' AND l_linenumber > 2 THEN 'occluded' WHEN l_returnflag = 'A' THEN 'iscrowd' END AS attribute,
  l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord
  FROM lineitem"""
#: SQL with the same three tables, to put before a query over images, categories and annotations.
WITH = f"WITH images AS ({IMAGES}), categories AS ({CATEGORIES}), annotations AS ({ANNOTATIONS})"
#: The second version's tables beside them.
WITH_CHANGED = WITH + """, images_b AS (SELECT * FROM images WHERE id % 53 <> 0),
annotations_b AS (SELECT id, image_id, category_id + CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END AS category_id,
  xmin + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS xmin, ymin, xmax + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS xmax, ymax, ord
  FROM annotations WHERE l_partkey % 37 <> 0)"""
