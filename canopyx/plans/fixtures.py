"""Detections, points and images derived from the driver's tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 1200

DET_SQL = """det AS (SELECT *, xmin + CAST(20 + l_quantity * 2 AS INTEGER) AS xmax, ymin + CAST(20 + l_linenumber * 12 AS INTEGER) AS ymax FROM (
  SELECT concat('img_', l_orderkey % 400) AS image_path, CAST(l_partkey * 37 % 1000 AS INTEGER) AS xmin, CAST(l_orderkey * 53 % 1000 AS INTEGER) AS ymin,
    l_returnflag AS label, l_extendedprice AS score, l_linestatus = 'O' AS is_truth, l_discount, l_quantity, l_linenumber,
    ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey AS ann_id FROM lineitem))"""
PTS_SQL = """pts AS (SELECT concat('img_', user_id % 50) AS image_path, CAST(event_id * 37 % 1000 AS INTEGER) AS x, CAST(event_id * 53 % 777 AS INTEGER) AS y,
  event_type AS label, value AS score, event_id % 2 = 0 AS is_truth, event_id AS ann_id FROM events)"""
IMAGES_SQL = "images AS (SELECT DISTINCT concat('img_', l_orderkey % 400) AS image_path, 1200 AS width, 1200 AS height, 0.1::DOUBLE AS res, CAST(1000 * (l_orderkey % 400) AS DOUBLE) AS \"left\", CAST(5000 * (l_orderkey % 400) AS DOUBLE) AS top FROM lineitem)"


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = d.select(
        F.expr("concat('img_', l_orderkey % 400)").alias("image_path"),
        F.expr("cast(l_partkey * 37 % 1000 as int)").alias("xmin"),
        F.expr("cast(l_orderkey * 53 % 1000 as int)").alias("ymin"),
        F.expr("cast(20 + l_quantity * 2 as int)").alias("_w"),
        F.expr("cast(20 + l_linenumber * 12 as int)").alias("_h"),
        F.col("l_returnflag").alias("label"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_linestatus") == "O").alias("is_truth"),
        "l_discount",
        F.expr("((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 10007 + l_suppkey").alias("ann_id"),
    )
    return d.select("ann_id", "image_path", "xmin", "ymin", (F.col("xmin") + F.col("_w")).alias("xmax"), (F.col("ymin") + F.col("_h")).alias("ymax"), "label", "score", "is_truth", "l_discount")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return d.select(F.col("event_id").alias("ann_id"), F.expr("concat('img_', user_id % 50)").alias("image_path"), F.expr("cast(event_id * 37 % 1000 as int)").alias("x"), F.expr("cast(event_id * 53 % 777 as int)").alias("y"), F.col("event_type").alias("label"), F.col("value").alias("score"), (F.col("event_id") % 2 == 0).alias("is_truth"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 400).alias("k")).distinct()
    return d.select(F.concat(F.lit("img_"), "k").alias("image_path"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(0.1).alias("res"), (F.col("k") * 1000).cast("double").alias("left"), (F.col("k") * 5000).cast("double").alias("top"))


def with_empty(d: DataFrame) -> DataFrame:
    """Rows without discount stand for empty frames."""
    return d.withColumns({c: F.when(F.col("l_discount") == 0, 0).otherwise(F.col(c)) for c in ("xmin", "ymin", "xmax", "ymax")})


EMPTY_SQL = "framed AS (SELECT ann_id, image_path, label, score, is_truth, " + ", ".join(f"CASE WHEN l_discount = 0 THEN 0 ELSE {c} END AS {c}" for c in ("xmin", "ymin", "xmax", "ymax")) + " FROM det)"
