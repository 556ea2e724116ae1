"""Named augmentations as one affine map for each image, composed in columns and applied once to boxes, points and polygons.

plan() turns names and options into a row for each image: the map from old to new coordinates, the new size, and how much of it
the content takes. Random choices are hashes of seed, step and path, so they are the same whatever the partitions, and the
same again for the pixels. Standard steps come first, then crops, then padding, each kind in the order given.

Annotations of images that have no plan go; null coordinates stay null and their rows go where a size is asked for. Boxes become
the bounds of their turned corners, cut by the content, and need a pixel each way; points need to lie in it; polygons keep all
their vertices and go where their bounds miss it. Repeated rows each stay. Names that change pixels alone leave geometry as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyx.types import BOX

#: Maps: x' = a x + b y + c, y' = d x + e y + f.
TERMS = ("a", "b", "c", "d", "e", "f")
Map = tuple[Column, ...]


def _map(*terms) -> Map:
    return tuple(t if isinstance(t, Column) else F.lit(float(t)) for t in terms)


def compose(after: Map, before: Map) -> Map:
    """The map that applies `before`, then `after`."""
    a, b, c, d, e, f = after
    p, q, r, s, t, u = before
    return a * p + b * s, a * q + b * t, a * r + b * u + c, d * p + e * s, d * q + e * t, d * r + e * u + f


def moved(m: Map, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def translation(x, y) -> Map:
    return _map(1, 0, x, 0, 1, y)


def scaling(x, y) -> Map:
    return _map(x, 0, 0, 0, y, 0)


def rotation(degrees: Column, x: Column, y: Column) -> Map:
    """Counter-clockwise as seen, about a point; the y axis points down."""
    turn = F.radians(degrees)
    return compose(translation(x, y), compose(_map(F.cos(turn), F.sin(turn), 0, -F.sin(turn), F.cos(turn), 0), translation(-x, -y)))


def uniform(seed: int, step: int, draw: str) -> Column:
    """A number from 0 to below 1 for each image_path, from 52 bits of a hash of `seed:step:draw:path`."""
    text = F.concat(F.lit(f"{seed}:{step}:{draw}:"), "image_path")
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high) - float(low))


def _whole(u: Column, most: Column) -> Column:
    """A whole number from 0 to most."""
    return F.floor(u * (F.greatest(most, F.lit(0.0)) + 1)).cast("double")


# Each step: (draw, width, height, options) to the map and the new width and height. draw(name) is a number of 0 to 1.


def _resize(draw, w, h, max_size=400):
    k = F.lit(float(max_size)) / F.greatest(w, h)
    return scaling(k, k), F.round(w * k), F.round(h * k)


def _crop(draw, w, h, size=(200, 200)):
    """A window of (height, width) at a random place; smaller images are kept from their upper left corner."""
    high, wide = (F.lit(float(s)) for s in size)
    return translation(-_whole(draw("x"), w - wide), -_whole(draw("y"), h - high)), wide, high


def _resized_crop(draw, w, h, size=(400, 400), scale=(0.5, 1.0), ratio=(1.0, 1.0)):
    """A window with a random share of the area and ratio of width to height (drawn evenly by logarithm), scaled to (height, width)."""
    area = w * h * _between(draw("scale"), *scale)
    shape = F.exp(_between(draw("ratio"), math.log(ratio[0]), math.log(ratio[1])))
    wide, high = F.least(F.round(F.sqrt(area * shape)), w), F.least(F.round(F.sqrt(area / shape)), h)
    to_high, to_wide = (F.lit(float(s)) for s in size)
    return compose(scaling(to_wide / wide, to_high / high), translation(-_whole(draw("x"), w - wide), -_whole(draw("y"), h - high))), to_wide, to_high


def _rotate(draw, w, h, degrees=15):
    low, high = (-degrees, degrees) if not isinstance(degrees, (tuple, list)) else degrees
    return rotation(_between(draw("angle"), low, high), w / 2, h / 2), w, h


def _pad_random(draw, w, h, pad_range=(0, 10), **_):
    low, high = (float(v) for v in pad_range)
    return _map(1, 0, 0, 0, 1, 0), w + F.floor(_between(draw("x"), low, high)), h + F.floor(_between(draw("y"), low, high))


def _pad_to(draw, w, h, size=(800, 800), **_):
    return _map(1, 0, 0, 0, 1, 0), F.greatest(w, F.lit(float(size[1]))), F.greatest(h, F.lit(float(size[0])))


STANDARD, CROP, PAD = range(3)
#: Names, how likely each is applied unless its options say so, and its kind.
STEPS: dict[str, tuple[Callable, float, int]] = {
    "HorizontalFlip": (lambda draw, w, h: (_map(-1, 0, w, 0, 1, 0), w, h), 0.5, STANDARD),
    "VerticalFlip": (lambda draw, w, h: (_map(1, 0, 0, 0, -1, h), w, h), 0.5, STANDARD),
    "Resize": (_resize, 1.0, STANDARD),
    "Rotate": (_rotate, 0.5, STANDARD),
    "RandomCrop": (_crop, 0.5, CROP),
    "RandomResizedCrop": (_resized_crop, 0.5, CROP),
    "RandomPadTo": (_pad_random, 0.5, PAD),
    "PadIfNeeded": (_pad_to, 1.0, PAD),
}
#: Names that leave geometry as it is.
PIXELS = ("RandomBrightnessContrast", "HueSaturationValue", "GaussNoise", "Blur", "GaussianBlur", "MotionBlur", "ZoomBlur")


def available() -> list[str]:
    return sorted([*STEPS, *PIXELS])


def parse(config: str | list | dict | None) -> dict[str, dict]:
    """Names to options, from a name, a list of names and of dicts with one name each, or a dict."""
    if config is None:
        return {}
    if isinstance(config, str):
        found = {config: {}}
    elif isinstance(config, dict):
        found = dict(config)
    elif isinstance(config, list):
        found = {}
        for entry in config:
            if isinstance(entry, str):
                found[entry] = {}
            elif isinstance(entry, dict) and len(entry) == 1:
                found |= entry
            else:
                raise ValueError(f"neither a name nor one name with options: {entry!r}")
    else:
        raise ValueError(f"not a list of augmentations: {config!r}")
    unknown = set(found) - set(available())
    if unknown:
        raise ValueError(f"unknown augmentations {sorted(unknown)}; there are {available()}")
    return {name: dict(options or {}) for name, options in found.items()}


def plan(images: DataFrame, config: str | list | dict | None, seed: int = 0) -> DataFrame:
    """image_path, map (a to f), width and height, content_w and content_h of each image (image_path, width, height)."""
    steps = [(n, o) for n, o in parse(config).items() if n in STEPS]
    out = images.select("image_path", *(F.col(c).cast("double").alias(c) for c in ("width", "height")))
    out = out.withColumns({"content_w": F.col("width"), "content_h": F.col("height")} | dict(zip(TERMS, _map(1, 0, 0, 0, 1, 0), strict=True)))
    for k, (name, options) in enumerate(sorted(steps, key=lambda s: STEPS[s[0]][2])):
        make, usual, kind = STEPS[name]
        share = options.pop("p", usual)
        try:
            step, w, h = make(lambda draw, k=k: uniform(seed, k, draw), F.col("width"), F.col("height"), **options)
        except TypeError as e:
            raise ValueError(f"{name}: {e}") from e
        chosen = F.lit(share >= 1) | (uniform(seed, k, "p") < share)
        new = dict(zip(TERMS, compose(step, tuple(F.col(t) for t in TERMS)), strict=True)) | {"width": w, "height": h}
        if kind != PAD:  # padding lies to the right and below
            new |= {"content_w": w, "content_h": h}
        out = out.withColumn("_on", chosen).withColumns({c: F.when(F.col("_on"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_on")
    return out.select("image_path", F.struct(*TERMS).alias("map"), "width", "height", "content_w", "content_h")


def apply(ann: DataFrame, plans: DataFrame) -> DataFrame:
    """ann (boxes, points or rings) in the plans' new coordinates; rings' xmin to ymax, where they are there, follow."""
    d = ann.join(plans.select("image_path", F.struct("map", "content_w", "content_h").alias("_p")), "image_path")
    m, w, h = tuple(F.col(f"_p.map.{t}") for t in TERMS), F.col("_p.content_w"), F.col("_p.content_h")
    if "rings" in ann.columns:
        from .polygons import with_bounds

        def vertex(v: Column) -> Column:
            x, y = moved(m, v["x"], v["y"])
            return F.struct(x.alias("x"), y.alias("y"))

        d = d.withColumn("rings", F.transform("rings", lambda part: F.transform(part, lambda ring: F.transform(ring, vertex))))
        own = with_bounds(d.withColumn("_kept", F.struct(*(c for c in BOX if c in ann.columns))) if set(BOX) & set(ann.columns) else d)
        own = own.where((F.col("xmax") > 0) & (F.col("ymax") > 0) & (F.col("xmin") < w) & (F.col("ymin") < h))
        return own.select(*ann.columns)
    if "x" in ann.columns:
        x, y = moved(m, F.col("x"), F.col("y"))
        return d.withColumns({"x": x, "y": y}).where(F.col("x").between(0, w) & F.col("y").between(0, h)).select(*ann.columns)
    corners = [moved(m, F.col(x), F.col(y)) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    new = {}
    for axis, most in enumerate((w, h)):
        low, high = ("xmin", "xmax") if axis == 0 else ("ymin", "ymax")
        new |= {low: cut(F.least(*(c[axis] for c in corners)), most), high: cut(F.greatest(*(c[axis] for c in corners)), most)}
    return d.withColumns(new).where("xmax - xmin >= 1 and ymax - ymin >= 1").select(*ann.columns)


def get_transform(config: str | list | dict | None = None, seed: int = 0) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function of (ann, images) that applies named augmentations."""
    parse(config)
    return lambda ann, images: apply(ann, plan(images, config, seed))
