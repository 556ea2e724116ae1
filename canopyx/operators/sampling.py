"""Samples that a seed fixes: the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def first_images(images: DataFrame, n: int) -> DataFrame:
    """The first n images by path."""
    return images.orderBy("image_path").limit(n)


def random_images(images: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement of distinct paths, each with its number (draw)."""
    return weighted_draws(images.select("image_path").distinct().withColumn("weight", F.lit(1.0)), n, ("image_path",), seed)


def _number(text, digits: int):
    """The first digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10)


def _last_up_to(sorted_: Column, n: int, value: Column) -> Column:
    """The last place of an array of n rising values that is not over a value, -1 without any: by halves."""
    steps = F.array(*(F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(-1), lambda at, step: F.when((at + step < n) & (F.get(sorted_, at + step) <= value), at + step).otherwise(at))


def weighted_draws(rows: DataFrame, n: int, key: tuple[str, ...], seed: int = 0) -> DataFrame:
    """n draws with replacement in proportion to `weight`; key orders the rows and makes the draws repeatable.

    Rows fall into hash buckets; a bucket's range on the line of cumulative weights comes from the buckets' sums (a fixed
    number of rows), a row's own range from a window within its bucket. A draw is a point on the line: it finds its bucket by the
    few bucket ranges, and its row by one more sort within the bucket, where ends of rows and draws lie side by side and each
    draw takes the nearest end above it. Rows without a positive weight are never drawn.
    """
    spark = rows.sparkSession
    text = F.concat_ws(":", F.lit("bucket"), *(F.col(k).cast("string") for k in key))
    dealt = rows.where("weight > 0").withColumn("_b", (_number(text, 8).cast("long") % BUCKETS).cast("int"))
    sums = {r["_b"]: r["s"] for r in dealt.groupBy("_b").agg(F.sum("weight").alias("s")).collect()}
    if not sums or n <= 0:
        return rows.withColumn("draw", F.lit(0).cast("long")).where("false")
    bounds, total = [], 0.0
    for b in sorted(sums):
        bounds.append((b, total))
        total += sums[b]
    by = Window.partitionBy("_b").orderBy(*key)
    ends = dealt.select("_b", F.struct(*(F.col(c) for c in rows.columns)).alias("_row"), F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_end"), F.lead(F.lit(1)).over(by).isNull().alias("_last"))
    # rounding loses no draw: the last row of a bucket takes all that is left
    ends = ends.select("_b", "_row", F.when(F.col("_last"), F.lit(float("inf"))).otherwise(F.col("_end")).alias("_at"))
    point = _number(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 13).cast("double") / float(1 << 52) * F.lit(total)
    names, starts = F.array(*(F.lit(b) for b, _ in bounds)), F.array(*(F.lit(lo) for _, lo in bounds))
    draws = spark.range(n).select(F.col("id").alias("draw"), point.alias("_at")).withColumn("_k", _last_up_to(starts, len(bounds), F.col("_at")))
    draws = draws.select(F.get(names, F.col("_k")).alias("_b"), "draw", (F.col("_at") - F.get(starts, F.col("_k"))).alias("_at"))
    both = ends.unionByName(draws, allowMissingColumns=True)
    # from above: an end at a draw's own place belongs to the row before it and must not be seen yet
    above = Window.partitionBy("_b").orderBy(F.desc("_at"), F.col("draw").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(above)).where("draw is not null")
    return found.select(*(F.col(f"_row.`{c}`").alias(c) for c in rows.columns), "draw")
