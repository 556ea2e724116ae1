"""Sinks. Each writes a folder in parallel; none gathers rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyx.operators.evaluate import metrics_long


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_image(df: DataFrame, path: str) -> None:
    """One folder for each image, for partition pruning."""
    df.repartition("image_path").write.mode("overwrite").partitionBy("image_path").option("header", True).csv(path)


def write_metrics(scalars: DataFrame, classes: DataFrame, path: str) -> None:
    rows = metrics_long(scalars)
    for c in ("recall", "precision"):
        rows = rows.unionByName(classes.select(F.concat(F.col("label"), F.lit(f"_{c}")).alias("metric"), F.col(c).alias("value")))
    write_csv(rows, path)


def with_wkt(df: DataFrame) -> DataFrame:
    """Boxes with a WKT polygon column."""
    p = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(" "), F.col(b).cast("string"))
    ring = F.concat_ws(", ", p("xmin", "ymin"), p("xmin", "ymax"), p("xmax", "ymax"), p("xmax", "ymin"), p("xmin", "ymin"))
    return df.withColumn("geometry", F.concat(F.lit("POLYGON (("), ring, F.lit("))")))
