"""Pixel and projected coordinates. images: image_path, left, top, res (and crs where it matters)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geo_to_image(ann: DataFrame, images: DataFrame) -> DataFrame:
    """Projected boxes to pixels. The y axis turns, so the box's top becomes ymin."""
    d = ann.join(images.select("image_path", "left", "top", "res"), "image_path")
    x = lambda c: (F.col(c) - F.col("left")) / F.col("res")
    y = lambda c: (F.col("top") - F.col(c)) / F.col("res")
    return d.withColumns({"xmin": x("xmin"), "xmax": x("xmax"), "ymin": y("ymax"), "ymax": y("ymin")}).drop("left", "top", "res")


def image_to_geo(ann: DataFrame, images: DataFrame, offset: float = 0.5, flip_y_axis: bool = False) -> DataFrame:
    """Pixel boxes or points to projected coordinates, at pixel centres (offset 0 for their upper left corners). flip_y_axis
    turns the y axis about zero."""
    d = ann.join(images.select("image_path", "left", "top", "res"), "image_path")
    x = lambda c: F.col("left") + (F.col(c) + offset) * F.col("res")
    y = lambda c: (F.col("top") - (F.col(c) + offset) * F.col("res")) * (-1 if flip_y_axis else 1)
    if "x" in ann.columns:
        return d.withColumns({"x": x("x"), "y": y("y")}).drop("left", "top", "res")
    low, high = ("ymin", "ymax") if flip_y_axis else ("ymax", "ymin")
    return d.withColumns({"xmin": x("xmin"), "xmax": x("xmax"), "ymin": y(low), "ymax": y(high)}).drop("left", "top", "res")


def points_geo_to_image(points: DataFrame, images: DataFrame) -> DataFrame:
    d = points.join(images.select("image_path", "left", "top", "res"), "image_path")
    return d.withColumns({"x": (F.col("x") - F.col("left")) / F.col("res"), "y": (F.col("top") - F.col("y")) / F.col("res")}).drop("left", "top", "res")


def to_bounds_origin(ann: DataFrame, left: float, bottom: float) -> DataFrame:
    """Moves boxes by the lower left corner of some bounds; none is dropped."""
    return ann.withColumns({"xmin": F.col("xmin") - left, "xmax": F.col("xmax") - left, "ymin": F.col("ymin") - bottom, "ymax": F.col("ymax") - bottom})


def scale_points(points: DataFrame, images: DataFrame, stride: int = 4) -> DataFrame:
    """Pixels to cells of a map that is smaller by the stride, a cell at least."""
    d = points.join(images.select("image_path", "width", "height"), "image_path")
    scaled = lambda c, side: F.col(c) * F.greatest(F.floor(F.col(side) / stride), F.lit(1)) / F.col(side)
    return d.withColumns({"x": scaled("x", "width"), "y": scaled("y", "height")}).drop("width", "height")


def unscale_points(points: DataFrame, images: DataFrame, stride: int = 4) -> DataFrame:
    """Cells of a map that is smaller by the stride back to pixels."""
    d = points.join(images.select("image_path", "width", "height"), "image_path")
    scaled = lambda c, side: F.col(c) * (F.col(side) / F.greatest(F.floor(F.col(side) / stride), F.lit(1)))
    return d.withColumns({"x": scaled("x", "width"), "y": scaled("y", "height")}).drop("width", "height")


def reject_geographic(srid: int | None) -> None:
    if srid == 4326:
        raise ValueError("geographic coordinates: project them first")


def _rings(ann: DataFrame, images: DataFrame, x, y) -> DataFrame:
    """Rings with x and y of each vertex replaced; xmin to ymax follow where they are there."""
    d = ann.join(images.select("image_path", "left", "top", "res"), "image_path")
    vertex = lambda v: F.struct(x(v["x"]).alias("x"), y(v["y"]).alias("y"))
    return d.withColumn("rings", F.transform("rings", lambda part: F.transform(part, lambda ring: F.transform(ring, vertex)))).drop("left", "top", "res")


def rings_image_to_geo(ann: DataFrame, images: DataFrame, offset: float = 0.5) -> DataFrame:
    """Polygons of pixels to projected coordinates, at pixel centres."""
    return _rings(ann, images, lambda v: F.col("left") + (v + offset) * F.col("res"), lambda v: F.col("top") - (v + offset) * F.col("res"))


def rings_geo_to_image(ann: DataFrame, images: DataFrame) -> DataFrame:
    """Projected polygons to pixels."""
    return _rings(ann, images, lambda v: (v - F.col("left")) / F.col("res"), lambda v: (F.col("top") - v) / F.col("res"))


def to_geo(ann: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations of any geometry in projected coordinates."""
    out = rings_image_to_geo(ann, images) if "rings" in ann.columns else ann
    return image_to_geo(out, images) if "x" in ann.columns or "xmin" in ann.columns else out


def to_pixels(ann: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations of any geometry in pixels."""
    out = rings_geo_to_image(ann, images) if "rings" in ann.columns else ann
    if "x" in ann.columns:
        return points_geo_to_image(out, images)
    return geo_to_image(out, images) if "xmin" in ann.columns else out
