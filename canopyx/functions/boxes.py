"""Column expressions on boxes, points, names and tiles. All stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyx.types import BOX

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in BOX)


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    """Common area, 0 if apart."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Null for two boxes without area."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union)


def centroid(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def around(x: Column, y: Column, margin) -> Box:
    return x - margin, y - margin, x + margin, y + margin


def is_empty(b: Box) -> Column:
    """The row that stands for an image without objects."""
    return (b[0] == 0) & (b[1] == 0) & (b[2] == 0) & (b[3] == 0)


def clamp(b: Box, width: Column, height: Column) -> Box:
    side = lambda v, most: F.least(F.greatest(v, F.lit(0)), most)
    return side(b[0], width), side(b[1], height), side(b[2], width), side(b[3], height)


def square(b: Box, width: Column, height: Column) -> Box:
    """A square on the longer side about the centre, moved into the image; where the side is over one of the image's, it is
    that side on both axes, from the image's edge on that axis."""
    side = F.greatest(b[2] - b[0], b[3] - b[1])
    fit = F.least(side, width, height)
    axis = lambda low, high, most: F.when(F.least(side, width) > most, F.lit(0.0)).otherwise(F.greatest(F.least((low + high) / 2 - side / 2, most - side), F.lit(0.0)))
    x, y = axis(b[0], b[2], width), axis(b[1], b[3], height)
    return x, y, x + fit, y + fit


def crop_window(bounds: Box, left: Column, top: Column, res: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Pixel offset and size (whole numbers) of projected bounds (left, bottom, right, top) in a raster, cut by it."""
    x0, y0 = F.floor((bounds[0] - left) / res + 1e-9), F.floor((top - bounds[3]) / res + 1e-9)
    x1, y1 = F.ceil((bounds[2] - left) / res - 1e-9), F.ceil((top - bounds[1]) / res - 1e-9)
    x0, y0, x1, y1 = clamp((x0, y0, x1, y1), width, height)
    return tuple(v.cast("int") for v in (x0, y0, x1 - x0, y1 - y0))


def expand(b: Box, margin: int, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Offset and size of a reading window that has a margin, at least one pixel each way."""
    x0, y0 = F.greatest(b[0] - margin, F.lit(0)), F.greatest(b[1] - margin, F.lit(0))
    x1, y1 = F.least(b[2] + margin, width), F.least(b[3] + margin, height)
    return x0.cast("int"), y0.cast("int"), F.greatest(x1 - x0, F.lit(1)).cast("int"), F.greatest(y1 - y0, F.lit(1)).cast("int")


def round_half_even(x: Column) -> Column:
    return F.bround(x.cast("double"), 0).cast("int")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def crop_name(path: Column, index: Column) -> Column:
    return F.concat(stem(path), F.lit("_"), index.cast("string"), F.lit(".png"))


def tile_numbers(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional Web-Mercator tile coordinates."""
    n = float(2**zoom)
    return (lon + 180.0) / 360.0 * n, (1.0 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2.0 * n


def decode_label(label: Column, names: dict) -> Column:
    """Number to name; what is not listed stays, null stays null."""
    if not names:
        return label
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(table, label), label.cast("string"))
