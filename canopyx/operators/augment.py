"""Geometric augmentations of boxes (xmin to ymax) and points (x, y) as column expressions. images: image_path, width, height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyx.types import BOX


def _sized(ann: DataFrame, images: DataFrame) -> DataFrame:
    return ann.join(images.select("image_path", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_path")


def _is_box(ann: DataFrame) -> bool:
    return "xmin" in ann.columns


def flip(ann: DataFrame, images: DataFrame, horizontal: bool = True) -> DataFrame:
    size, axis = ("_w", "x") if horizontal else ("_h", "y")
    d = _sized(ann, images)
    new = {f"{axis}min": F.col(size) - F.col(f"{axis}max"), f"{axis}max": F.col(size) - F.col(f"{axis}min")} if _is_box(ann) else {axis: F.col(size) - F.col(axis)}
    return d.withColumns(new).drop("_w", "_h")


def rotate_quarter(ann: DataFrame, images: DataFrame) -> DataFrame:
    """A quarter turn to the left: the image's right side becomes its top."""
    d = _sized(ann, images)
    new = {"xmin": F.col("ymin"), "xmax": F.col("ymax"), "ymin": F.col("_w") - F.col("xmax"), "ymax": F.col("_w") - F.col("xmin")} if _is_box(ann) else {"x": F.col("y"), "y": F.col("_w") - F.col("x")}
    return d.withColumns(new).drop("_w", "_h")


def crop(ann: DataFrame, x: Column | int, y: Column | int, width: int, height: int) -> DataFrame:
    """Moved to a crop's origin and cut by it; boxes that keep no pixel and points outside go."""
    x, y = (v if isinstance(v, Column) else F.lit(v) for v in (x, y))
    if not _is_box(ann):
        return ann.withColumns({"x": F.col("x") - x, "y": F.col("y") - y}).where(F.col("x").between(0, width) & F.col("y").between(0, height))
    cut = lambda c, start, most: F.least(F.greatest(F.col(c) - start, F.lit(0)), F.lit(most))
    moved = ann.withColumns({"xmin": cut("xmin", x, width), "xmax": cut("xmax", x, width), "ymin": cut("ymin", y, height), "ymax": cut("ymax", y, height)})
    return moved.where("xmax - xmin >= 1 and ymax - ymin >= 1")


def pad(ann: DataFrame, left: int, top: int) -> DataFrame:
    new = {c: F.col(c) + (left if c.startswith("x") else top) for c in (BOX if _is_box(ann) else ("x", "y"))}
    return ann.withColumns(new)


def resize(ann: DataFrame, images: DataFrame, width: int, height: int) -> DataFrame:
    d = _sized(ann, images)
    new = {c: F.col(c) * (F.lit(width) / F.col("_w") if c.startswith("x") else F.lit(height) / F.col("_h")) for c in (BOX if _is_box(ann) else ("x", "y"))}
    return d.withColumns(new).drop("_w", "_h")


def randomly(ann: DataFrame, changed: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """For a share of the images the rows of `changed`, for the others those of ann; the choice depends on path and seed only."""
    chosen = F.pmod(F.xxhash64(F.lit(seed), "image_path"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    return changed.where(chosen).unionByName(ann.where(~chosen))


#: Names of augmentations, in the order in which get_transform() puts them: standard ones, then crops, then padding.
ORDER = {"HorizontalFlip": 0, "VerticalFlip": 0, "Rotate90": 0, "Resize": 0, "Crop": 1, "Pad": 2}


def get_transform(steps: list[tuple[str, dict]]):
    """A function of (ann, images) that applies named steps, standard ones first, then crops, then padding."""
    unknown = [n for n, _ in steps if n not in ORDER]
    if unknown:
        raise ValueError(f"unknown augmentations {unknown}; there are {sorted(ORDER)}")
    apply = {
        "HorizontalFlip": lambda a, i: flip(a, i),
        "VerticalFlip": lambda a, i: flip(a, i, False),
        "Rotate90": lambda a, i: rotate_quarter(a, i),
        "Resize": lambda a, i, **k: resize(a, i, **k),
        "Crop": lambda a, i, **k: crop(a, **k),
        "Pad": lambda a, i, **k: pad(a, **k),
    }

    def run(ann: DataFrame, images: DataFrame) -> DataFrame:
        for name, options in sorted(steps, key=lambda s: ORDER[s[0]]):
            ann = apply[name](ann, images, **options)
        return ann

    return run
