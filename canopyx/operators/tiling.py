"""Windows over images, and annotations in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyx.functions import boxes

KEEP_RATIO = 0.5
#: Pixels of a side of the grid cells that annotations and windows meet in.
CELL = 512


def windows(images: DataFrame, patch: int = 400, overlap: float = 0.05) -> DataFrame:
    """Sliding windows (images: image_path, width, height); the last of a row or column moves inward to stay whole."""
    if overlap > 1:
        raise ValueError("overlap is over 1")

    def starts(side: str):
        size = F.least(F.lit(patch), F.col(side))
        step = F.greatest(size - F.floor(size * F.lit(overlap)).cast("int"), F.lit(1))
        return F.array_distinct(F.concat(F.sequence(F.lit(0), F.col(side) - size, step), F.array(F.col(side) - size)))

    grid = images.select("image_path", "width", "height", F.posexplode(starts("width")).alias("i", "window_xmin"), starts("height").alias("ys"))
    grid = grid.select("*", F.posexplode("ys").alias("j", "window_ymin"))
    return grid.select("image_path", (F.col("i") * F.size("ys") + F.col("j")).cast("int").alias("window_index"), F.col("window_xmin").cast("int").alias("window_xmin"), F.col("window_ymin").cast("int").alias("window_ymin"), F.least(F.lit(patch), "width").cast("int").alias("window_w"), F.least(F.lit(patch), "height").cast("int").alias("window_h"))


def windows_padded(images: DataFrame, patch: int = 400, overlap: float = 0.05) -> DataFrame:
    """Row-major windows of full size that may reach beyond the image."""
    margin = int(patch * overlap)
    step = patch - margin
    starts = lambda side: F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.col(side) - margin) / step).cast("int")), lambda k: k * step), lambda s: s < F.col(side))
    grid = images.select("image_path", F.posexplode(starts("height")).alias("j", "window_ymin"), starts("width").alias("xs"))
    grid = grid.select("*", F.posexplode("xs").alias("i", "window_xmin"))
    return grid.select("image_path", (F.col("j") * F.size("xs") + F.col("i")).cast("int").alias("window_index"), F.col("window_xmin").cast("int").alias("window_xmin"), F.col("window_ymin").cast("int").alias("window_ymin"), F.lit(patch).alias("window_w"), F.lit(patch).alias("window_h"))


def _in_cells(df: DataFrame, x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """A row for each grid cell that the range touches, ends included."""
    span = lambda ends: F.sequence(*(F.floor(F.col(c) / CELL) for c in ends))
    return df.withColumn("_cx", F.explode(span(x))).withColumn("_cy", F.explode(span(y)))


def _window_cells(wins: DataFrame) -> DataFrame:
    w = wins.withColumns({"_x1": F.col("window_xmin") + F.col("window_w"), "_y1": F.col("window_ymin") + F.col("window_h")})
    return _in_cells(w, ("window_xmin", "_x1"), ("window_ymin", "_y1"))


def annotations_per_window(ann: DataFrame, wins: DataFrame, keep_ratio: float = KEEP_RATIO) -> DataFrame:
    """Boxes cut by each window they touch and moved to its origin, where more than keep_ratio of the area is left.

    Both sides are dealt to grid cells, so a box meets the windows near it only, whatever the image's size; a pair counts in
    the cell that holds the upper left corner of what they share.
    """
    near = (F.col("xmin") < F.col("_x1")) & (F.col("xmax") > F.col("window_xmin")) & (F.col("ymin") < F.col("_y1")) & (F.col("ymax") > F.col("window_ymin"))
    cut = (F.greatest("xmin", "window_xmin"), F.greatest("ymin", "window_ymin"), F.least("xmax", "_x1"), F.least("ymax", "_y1"))
    own = (F.col("_cx") == F.floor(cut[0] / CELL)) & (F.col("_cy") == F.floor(cut[1] / CELL))
    both = _in_cells(ann, ("xmin", "xmax"), ("ymin", "ymax")).join(_window_cells(wins), ["image_path", "_cx", "_cy"]).where(near & own)
    both = both.where(boxes.area(cut) > F.lit(keep_ratio) * boxes.area(boxes.box()))
    moved = {"xmin": cut[0] - F.col("window_xmin"), "ymin": cut[1] - F.col("window_ymin"), "xmax": cut[2] - F.col("window_xmin"), "ymax": cut[3] - F.col("window_ymin")}
    return both.withColumns(moved).drop("_x1", "_y1", "_cx", "_cy")


def points_per_window(ann: DataFrame, wins: DataFrame) -> DataFrame:
    """Points in or on each window, moved to its origin. A point has one grid cell, and a window all that it touches."""
    inside = F.col("x").between(F.col("window_xmin"), F.col("_x1")) & F.col("y").between(F.col("window_ymin"), F.col("_y1"))
    both = _in_cells(ann, ("x", "x"), ("y", "y")).join(_window_cells(wins), ["image_path", "_cx", "_cy"]).where(inside)
    return both.withColumns({"x": F.col("x") - F.col("window_xmin"), "y": F.col("y") - F.col("window_ymin")}).drop("_x1", "_y1", "_cx", "_cy")


def empty_windows(ann: DataFrame, wins: DataFrame, keep_ratio: float = KEEP_RATIO) -> DataFrame:
    """Windows that keep no annotation."""
    return wins.join(annotations_per_window(ann, wins, keep_ratio).select("image_path", "window_index").distinct(), ["image_path", "window_index"], "left_anti")


def split_annotations(ann: DataFrame, wins: DataFrame, allow_empty: bool = False, empty_label: str | None = None) -> DataFrame:
    """image_path (the crop's name), label and box for each kept annotation; all-zero rows for empty windows if allowed."""
    named = boxes.crop_name(F.col("image_path"), F.col("window_index"))
    out = annotations_per_window(ann, wins).select(named.alias("image_path"), "label", *boxes.box())
    if not allow_empty:
        return out
    zero = [F.lit(0).cast(ann.schema[c].dataType).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return out.unionByName(empty_windows(ann, wins).select(named.alias("image_path"), F.lit(empty_label).cast("string").alias("label"), *zero))


def split_raster(ann: DataFrame, images: DataFrame, patch: int = 400, overlap: float = 0.05, allow_empty: bool = False, empty_label: str | None = None) -> DataFrame:
    """split_annotations over the windows of images, after its checks: a patch may not be larger than an image, each image
    needs annotations (unless empty crops are allowed), and no annotation may be of an unknown image."""
    small = images.where((F.col("width") < patch) | (F.col("height") < patch)).select("image_path").limit(5).collect()
    if small:
        raise ValueError(f"the patch of {patch} is larger than {[r['image_path'] for r in small]}")
    if not allow_empty:
        bare = images.join(ann.select("image_path").distinct(), "image_path", "left_anti").select("image_path").limit(5).collect()
        if bare:
            raise ValueError(f"no annotations for {[r['image_path'] for r in bare]}")
    return split_annotations(ann, windows(images, patch, overlap), allow_empty, empty_label)
