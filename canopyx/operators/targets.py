"""Training targets by image, and their shards: what a dataset hands to a training loop, in an order that a seed and an epoch fix.

Targets are rows, one for each annotation, those of an image side by side; an image without any has one row without geometry. So
an image of any size is many rows of a sorted table and never one list. An image belongs to one shard by a hash of its path,
and to a place in it by a hash of seed, epoch and path. A rank reads the shards that are its own, pruned by folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyx.functions import boxes
from canopyx.sources.readers import encode_label
from canopyx.types import BOX

from . import validate

#: Rows of one file at most.
PER_FILE = 1_000_000


def targets(ann: DataFrame, images: DataFrame, labels: dict[str, int]) -> DataFrame:
    """Annotations (boxes, points or rings; further columns such as runs, area and iscrowd travel along) of images (image_path,
    width, height): labels as numbers, boxes cut by the image, and those that keep no pixel, points outside and polygons
    without parts left out. Images without any left have one row, all else null. Unknown labels raise; annotations of unknown
    images go."""
    sized = validate.drop_empty(ann).join(images.select("image_path", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_path")
    if "xmin" in ann.columns:
        sized = validate.clamp_boxes(sized, F.col("_w"), F.col("_h"))
    elif "x" in ann.columns:
        sized = validate.points_in_image(sized, F.col("_w"), F.col("_h"))
    coded = sized.drop("_w", "_h").withColumn("label", encode_label(F.col("label"), labels).cast("int"))
    return images.select("image_path").distinct().join(coded, "image_path", "left")


def _number(text, digits: int):
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def shard_of(shards: int):
    """The shard of an image, whatever the epoch."""
    return (_number(F.concat(F.lit("shard:"), "image_path"), 8) % shards).cast("int")


def place(seed: int, epoch: int):
    """Where an image stands in an epoch."""
    return _number(F.concat(F.lit(f"{seed}:{epoch}:"), "image_path"), 15)


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """targets() as a Parquet table of `shards` folders under path/data, each sorted by place, and a manifest under
    path/manifest (shard, images, rows, and first and last place), which is returned. The manifest is written last, from what
    was written, so a folder without one is not whole."""
    if shards < 1:
        raise ValueError("at least one shard")
    spark, order = rows.sparkSession, [c for c in ("ann_id",) if c in rows.columns]
    keyed = rows.withColumns({"shard": shard_of(shards), "place": place(seed, epoch)})
    by = ["shard", "place", "image_path", *order]
    keyed.repartition("shard").sortWithinPartitions(*by).write.mode("overwrite").option("maxRecordsPerFile", PER_FILE).partitionBy("shard").parquet(f"{path}/data")
    stored = spark.read.schema(T.StructType([f for f in keyed.schema.fields if f.name != "shard"] + [T.StructField("shard", T.IntegerType())])).parquet(f"{path}/data")
    each = stored.groupBy("shard", "image_path").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    manifest = each.groupBy("shard").agg(F.count("*").alias("images"), F.sum("n").alias("rows"), F.min("place").alias("first"), F.max("place").alias("last"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(manifest, "shard", "left").na.fill(0, ["images", "rows"])
    every.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(every.schema).parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, rank: int = 0, world: int = 1) -> DataFrame:
    """The targets of one of `world` ranks: those whose shard is its own, in no order between tasks; in_order() restores it."""
    if not 0 <= rank < world:
        raise ValueError(f"rank {rank} of {world}")
    own = [r["shard"] for r in spark.read.parquet(f"{path}/manifest").select("shard").collect() if r["shard"] % world == rank]  # a number for each shard
    return spark.read.parquet(f"{path}/data").where(F.col("shard").isin(own) if own else F.lit(False))


def in_order(rows: DataFrame) -> DataFrame:
    """A task for each shard, its images in the epoch's order."""
    order = [c for c in ("ann_id",) if c in rows.columns]
    return rows.repartition("shard").sortWithinPartitions("shard", "place", "image_path", *order)


def per_image(rows: DataFrame, f: Callable[[str, pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """f(image_path, its rows) for each image of in_order() rows; holds one image's rows, and a batch. Images without objects
    come with no rows."""
    object_ = next(c for c in ("xmin", "x", "rings", "label") if c in rows.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            whole = pd.concat(held, ignore_index=True)
            held.clear()
            return f(whole["image_path"].iloc[0], whole[whole[object_].notna()].reset_index(drop=True))

        for frame in frames:
            for name, part in frame.groupby("image_path", sort=False):
                if held and held[0]["image_path"].iloc[0] != name:
                    yield done()
                held.append(part)
        if held:
            yield done()

    return in_order(rows).mapInPandas(run, schema)


def for_images(ann: DataFrame, paths: list[str] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """image_path and its targets as arrays of equal length (boxes or points, labels, and further columns): for images that fit
    in a row."""
    some = ann if paths is None else ann.where(F.col("image_path").isin(paths))
    geometry = ("boxes", F.array(*boxes.box())) if set(BOX) <= set(ann.columns) else ("points", F.array("x", "y"))
    item = F.struct(F.col("ann_id"), geometry[1].alias(geometry[0]), F.col("label").alias("labels"), *(F.col(c) for c in extra))
    grouped = some.groupBy("image_path").agg(F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), item))).alias("_t"))
    return grouped.select("image_path", *(F.col(f"_t.{c}").alias(c) for c in (geometry[0], "labels", *extra)))
