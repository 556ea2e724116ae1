"""An extension: matches that arrive as a stream, with running counts by image under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """stream (time, label, score): detections and their mean score by window and label."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, every), "label").agg(F.count("*").alias("n"), F.avg("score").alias("score"))
