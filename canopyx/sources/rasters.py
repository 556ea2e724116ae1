"""Images and rasters: bytes come through Spark's reader, so any path that Spark can read will do.

Pixels are decoded in tasks, one file at a time, by a reader that the caller may give; the one here knows binary PPM and PGM
(8 bits). A pixel is three values of 0 to 1. Window arithmetic is DataFrame expressions: windows travel as rows with their own
metadata, so crops of images of any sizes share one relation keyed by image and window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyx.functions import boxes

Reader = Callable[[bytes], np.ndarray]

#: Windows of an image, on average, that one copy of its file serves.
PER_READ = 256

CROP = "image_path string, window_index long, window_xmin int, window_ymin int, window_w int, window_h int, pixels array<float>"


def read_pnm(data: bytes) -> np.ndarray:
    """Height x width x channels of a binary PPM (P6) or PGM (P5) of 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while end < len(data) and data[end : end + 1].strip():
            end += 1
        token = data[at:end]
        if token.startswith(b"#"):
            at = data.index(b"\n", at) + 1
            continue
        if token:
            fields.append(token)
        if end >= len(data) and len(fields) < 4:
            raise ValueError("the header ends too soon")
        at = end + 1
    kind, width, height, most = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or most > 255:
        raise ValueError(f"not a binary PPM or PGM of 8 bits: {kind!r}, {most}")
    bands = 3 if kind == b"P6" else 1
    return np.frombuffer(data, np.uint8, width * height * bands, at).reshape(height, width, bands)


def as_rgb(pixels: np.ndarray) -> np.ndarray:
    """Three channels of 0 to 1: one channel is repeated, further ones are dropped, values outside 0 to 1 are taken as of 255."""
    some = np.atleast_3d(pixels)
    some = np.repeat(some, 3, axis=2) if some.shape[2] == 1 else some[:, :, :3]
    if some.shape[2] != 3:
        raise ValueError(f"an image needs one channel or three, not {some.shape[2]}")
    some = some.astype(np.float32)
    return some / 255 if some.size and (some.max() > 1 or some.min() < 0) else some


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(boxes.basename(F.col("path")).alias("image_path"), "content")


def image_sizes(spark: SparkSession, path: str, reader: Reader = read_pnm) -> DataFrame:
    """image_path, width and height of each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            shapes = [reader(bytes(c)).shape for c in f["content"]]
            yield pd.DataFrame({"image_path": f["image_path"], "width": [s[1] for s in shapes], "height": [s[0] for s in shapes]})

    return _files(spark, path).mapInPandas(run, "image_path string, width int, height int")


def crops(spark: SparkSession, path: str, windows: DataFrame, reader: Reader = read_pnm) -> DataFrame:
    """The pixels of each window, channels first, flat; the window's columns travel along. A window that reaches beyond its
    image is filled with zeros. A file is sent once for each PER_READ of its windows, about."""
    columns = [c.split()[0] for c in CROP.split(", ")]
    names = columns[1:-1]
    # an image with many windows is several rows, so that neither its list nor its crops are one task's
    parts = windows.groupBy("image_path").agg(F.ceil(F.count("*") / PER_READ).alias("_parts"))
    part = F.pmod(F.xxhash64("window_index"), F.col("_parts")).alias("_part")
    dealt = windows.join(parts, "image_path").groupBy("image_path", part).agg(F.collect_list(F.struct(*names)).alias("windows"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content, wins in zip(frame["image_path"], frame["content"], frame["windows"], strict=True):
                image = as_rgb(reader(bytes(content)))
                for w in wins:
                    x, y, wide, high = (int(w[c]) for c in names[1:])
                    out = np.zeros((3, high, wide), np.float32)
                    part = image[max(0, y) : max(0, y + high), max(0, x) : max(0, x + wide)].transpose(2, 0, 1)
                    out[:, max(0, -y) : max(0, -y) + part.shape[1], max(0, -x) : max(0, -x) + part.shape[2]] = part
                    yield pd.DataFrame([(name, int(w["window_index"]), x, y, wide, high, out.ravel())], columns=columns)

    return _files(spark, path).join(dealt, "image_path").repartition("image_path", "_part").mapInPandas(cut, CROP)


def whole_images(images: DataFrame) -> DataFrame:
    """Each image as one window, number 0."""
    return images.select("image_path", F.lit(0).alias("window_index"), F.lit(0).alias("window_xmin"), F.lit(0).alias("window_ymin"), F.col("width").cast("int").alias("window_w"), F.col("height").cast("int").alias("window_h"))


def crop_windows(bounds: DataFrame, images: DataFrame) -> DataFrame:
    """Windows of pixels for bounds (image_path, window_index, left, bottom, right, top), cut at the image's border; rows for
    crops(). With a column res, images have a left and top too and bounds are in their coordinates; else bounds are pixels,
    bottom being the lesser row. Bounds off the image raise."""
    columns = ["image_path", "width", "height"] + (["left", "top", "res"] if "res" in images.columns else [])
    d = bounds.select("image_path", "window_index", F.struct("left", "bottom", "right", "top").alias("b")).join(images.select(*columns), "image_path")
    b = tuple(F.col(f"b.{c}") for c in ("left", "bottom", "right", "top"))
    if "res" in columns:
        x, y, w, h = boxes.crop_window(b, F.col("left"), F.col("top"), F.col("res"), F.col("width"), F.col("height"))
    else:
        x0, y0, x1, y1 = boxes.clamp((F.floor(b[0]), F.floor(b[1]), F.ceil(b[2]), F.ceil(b[3])), F.col("width"), F.col("height"))
        x, y, w, h = x0, y0, x1 - x0, y1 - y0
    none = F.raise_error(F.concat(F.lit("no pixels within the bounds of "), "image_path")).cast("int")
    found = d.select("image_path", "window_index", x.cast("int").alias("window_xmin"), y.cast("int").alias("window_ymin"), w.cast("int").alias("window_w"), h.cast("int").alias("window_h"))
    return found.withColumn("window_w", F.when((F.col("window_w") > 0) & (F.col("window_h") > 0), F.col("window_w")).otherwise(none))


def label_crops(ann: DataFrame, images: DataFrame) -> DataFrame:
    """A square window within the image around each box, numbered by ann_id, with its label: rows for crops() and
    write_crops(). Boxes without an area have none."""
    d = ann.where((F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin"))).join(images.select("image_path", "width", "height"), "image_path")
    x0, y0, x1, y1 = (v.cast("int") for v in boxes.square(boxes.box(), F.col("width"), F.col("height")))
    return d.select("image_path", "ann_id", "label", F.col("ann_id").alias("window_index"), x0.alias("window_xmin"), y0.alias("window_ymin"), (x1 - x0).alias("window_w"), (y1 - y0).alias("window_h"))


def write_crops(spark: SparkSession, path: str, windows: DataFrame, out: str, reader: Reader = read_pnm) -> None:
    """Crops as a Parquet table, a folder for each label where windows have one; none passes through the driver."""
    names = windows.select("image_path", "window_index", F.col("label") if "label" in windows.columns else F.lit("").alias("label"))
    found = crops(spark, path, windows, reader).join(names, ["image_path", "window_index"])
    named = found.withColumn("crop_path", F.concat("label", F.lit("/"), boxes.crop_name(F.col("image_path"), F.col("window_index"))))
    named.write.mode("overwrite").partitionBy("label").parquet(out)
