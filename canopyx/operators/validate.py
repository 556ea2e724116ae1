"""Filters and checks of annotations. Checks return rows; raise_if() turns them into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyx.functions import boxes


def drop_empty(ann: DataFrame) -> DataFrame:
    """Without the rows that stand for images without objects: boxes of zeros, points at zero, polygons without parts."""
    if "xmin" in ann.columns:
        return ann.where(~boxes.is_empty(boxes.box()))
    return ann.where("not (x = 0 and y = 0)") if "x" in ann.columns else ann.where("size(rings) > 0")


def empty_images(ann: DataFrame) -> DataFrame:
    """Images whose boxes' coordinates sum to zero."""
    total = F.sum(F.col("xmin") + F.col("ymin") + F.col("xmax") + F.col("ymax"))
    return ann.groupBy("image_path").agg(total.alias("_s")).where("_s = 0").select("image_path")


def annotations_for_path(ann: DataFrame, path: str, labels: dict[str, int]) -> DataFrame:
    """An image's rows with their labels as numbers; an unknown label raises when it is met."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    known = F.try_element_at(table, F.col("label"))
    return ann.where(F.col("image_path") == path).withColumn("label", F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label "), "label")).cast("int")))


def drop_missing(rows: DataFrame, value: str) -> DataFrame:
    """Without rows whose value is null or an empty array."""
    is_list = rows.schema[value].dataType.typeName() == "array"
    return rows.where(F.col(value).isNotNull() & ((F.size(value) > 0) if is_list else F.lit(True)))


def drop_degenerate(ann: DataFrame) -> DataFrame:
    return ann.where("xmin <> xmax and ymin <> ymax")


def clamp_boxes(ann: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut by the image, where they stay a pixel wide and high."""
    cut = boxes.clamp(boxes.box(), width, height)
    return ann.withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), cut, strict=True))).where("xmax - xmin >= 1 and ymax - ymin >= 1")


def points_in_image(points: DataFrame, width: Column, height: Column) -> DataFrame:
    return points.where(F.col("x").between(0, width) & F.col("y").between(0, height))


def score_filter(pred: DataFrame, least: float = 0.1) -> DataFrame:
    return pred.where(F.col("score") > least)


def missing_labels(ann: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of ann that are not in labels(label)."""
    return ann.select("label").distinct().join(labels, "label", "left_anti")


def _issues(rows: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return rows.select(*keep, found.alias("issues")).where(F.size("issues") > 0)


def box_issues(ann: DataFrame, images: DataFrame, keep: tuple[str, ...] = ("ann_id", "image_path")) -> DataFrame:
    """Rows with a list of what is wrong; empty frames are fine. images (image_path, width, height)."""
    rows = drop_empty(ann).join(images, "image_path", "left")
    rules = {
        "unknown image": F.col("width").isNull(),
        "xmin < 0": F.col("xmin") < 0,
        "xmax > width": F.col("xmax") > F.col("width"),
        "ymin < 0": F.col("ymin") < 0,
        "ymax > height": F.col("ymax") > F.col("height"),
        "area of a single pixel": F.abs(boxes.area(boxes.box()) - 1) <= 1e-9,
    }
    return _issues(rows, rules, list(keep))


def point_issues(points: DataFrame, images: DataFrame, keep: tuple[str, ...] = ("ann_id", "image_path")) -> DataFrame:
    rows = points.join(images, "image_path", "left")
    rules = {"unknown image": F.col("width").isNull(), "x outside": ~F.col("x").between(0, F.col("width")), "y outside": ~F.col("y").between(0, F.col("height"))}
    return _issues(rows, rules, list(keep))


def outside_rasters(ann: DataFrame, images: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Images (image_path) whose annotations' bounds leave the raster by more than the tolerance."""
    b = ann.groupBy("image_path").agg(F.min("xmin").alias("x0"), F.min("ymin").alias("y0"), F.max("xmax").alias("x1"), F.max("ymax").alias("y1")).join(images, "image_path")
    w, h, t = F.col("width"), F.col("height"), F.lit(tolerance)
    return b.where((F.col("x0") < -t * w) | (F.col("y0") < -t * h) | (F.col("x1") > (1 + t) * w) | (F.col("y1") > (1 + t) * h)).select("image_path")


def total_bounds(ann: DataFrame) -> DataFrame:
    return ann.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def outside_raster(ann: DataFrame, width: int, height: int, tolerance: float = 0.1) -> bool:
    """Whether the annotations' bounds leave the raster by more than the tolerance."""
    b = total_bounds(ann).first()
    return b["xmin"] is not None and (b["xmin"] < -tolerance * width or b["ymin"] < -tolerance * height or b["xmax"] > (1 + tolerance) * width or b["ymax"] > (1 + tolerance) * height)


def raise_if(rows: DataFrame, what: str, show: int = 20) -> None:
    """An error with the first rows, if there are any."""
    found = rows.limit(show).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")
