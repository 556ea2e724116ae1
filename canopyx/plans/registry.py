"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyx.functions import boxes
from canopyx.operators import affine, augment, coords, density, evaluate, matching, overlaps, overlay, polygons, precision, runs, sampling, suppress, targets, tiling, validate
from canopyx.shared import shared_dir, written
from canopyx.sources import rasters, readers, tiff, vector, vector_sink

from .fixtures import DET_SQL, EMPTY_SQL, IMAGES_SQL, PTS_SQL, det, images, pts, with_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BOX = "xmin, ymin, xmax, ymax"
_ID = ["ann_id", "image_path"]
_ROW = [*_ID, "xmin", "ymin", "xmax", "ymax", "label", "score"]
_LABELS = {"A": 0, "N": 1, "R": 2}


def query(sql: str | None = None, *parts: str):
    """Registers a function under its name, with SQL over the named common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql
        return f

    return add


def _truth(d: DataFrame) -> DataFrame:
    return d.where("is_truth").drop("is_truth")


def _pred(d: DataFrame) -> DataFrame:
    return d.where("not is_truth").drop("is_truth")


# Scans and projections


@query(f"SELECT ann_id, image_path, {_BOX}, label, score, 'data' AS root_dir FROM det", DET_SQL)
def read_boxes(spark, sf):
    return readers.read_annotations(spark, det(spark, sf).select(*_ROW), root_dir="data")


@query("SELECT image_path, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax, label, score FROM det", DET_SQL)
def format_boxes(spark, sf):
    d = det(spark, sf)
    raw = d.select("image_path", F.array(F.array(*(F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")))).alias("boxes"), F.array("label").alias("labels"), F.array("score").alias("scores"))
    return readers.predictions(raw)


@query("SELECT image_path, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, label, score FROM pts", PTS_SQL)
def format_points(spark, sf):
    raw = pts(spark, sf).select("image_path", F.array(F.array(F.col("x").cast("double"), F.col("y").cast("double"))).alias("points"), F.array("label").alias("labels"), F.array("score").alias("scores"))
    return readers.predictions(raw, "point")


@query("SELECT ann_id, image_path, x - 10 AS xmin, y - 10 AS ymin, x + 10 AS xmax, y + 10 AS ymax FROM pts", PTS_SQL)
def point_to_box(spark, sf):
    return pts(spark, sf).select(*_ID, *(v.alias(c) for c, v in zip(("xmin", "ymin", "xmax", "ymax"), boxes.around(F.col("x"), F.col("y"), 10), strict=True)))


@query("SELECT ann_id, image_path, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM det", DET_SQL)
def box_centroid(spark, sf):
    x, y = boxes.centroid(boxes.box())
    return det(spark, sf).select(*_ID, x.alias("x"), y.alias("y"))


@query(f"SELECT ann_id, image_path, xmin - 5 AS xmin, ymin - 7 AS ymin, xmax - 5 AS xmax, ymax - 7 AS ymax FROM det", DET_SQL)
def bounds_origin(spark, sf):
    return coords.to_bounds_origin(det(spark, sf), 5, 7).select(*_ID, "xmin", "ymin", "xmax", "ymax")


_GEO = 'ROUND(("left" + (xmin + 0.5) * res), 6) AS xmin, ROUND((top - (ymax + 0.5) * res), 6) AS ymin, ROUND(("left" + (xmax + 0.5) * res), 6) AS xmax, ROUND((top - (ymin + 0.5) * res), 6) AS ymax'


@query(f"SELECT ann_id, image_path, {_GEO} FROM det JOIN images USING (image_path)", DET_SQL, IMAGES_SQL)
def image_to_geo(spark, sf):
    d = coords.image_to_geo(det(spark, sf), images(spark, sf))
    return d.select(*_ID, *(F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


@query('SELECT ann_id, image_path, ROUND((1000.0 + xmin - "left") / res, 4) AS xmin, ROUND((top - ymax) / res, 4) AS ymin, ROUND((1000.0 + xmax - "left") / res, 4) AS xmax, ROUND((top - ymin) / res, 4) AS ymax FROM det JOIN images USING (image_path)', DET_SQL, IMAGES_SQL)
def geo_to_image(spark, sf):
    d = det(spark, sf).withColumns({"xmin": F.col("xmin") + 1000.0, "xmax": F.col("xmax") + 1000.0})
    return coords.geo_to_image(d, images(spark, sf)).select(*_ID, *(F.round(c, 4).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


def _windowed(d: DataFrame, cols: list[str]) -> DataFrame:
    """Coordinates as if found in windows of 400."""
    move = {c: F.col(c) % 400 for c in cols}
    return d.withColumns({"window_xmin": (F.col(cols[0]) / 400).cast("int") * 400, "window_ymin": (F.col(cols[1]) / 400).cast("int") * 400} | {c: F.col(c) + (v - v) for c, v in move.items()})


@query("SELECT ann_id, image_path, CAST(trunc(xmin + 0.75 + (xmin // 400) * 400) AS INTEGER) AS xmin, CAST(trunc(ymin + 0.75 + (ymin // 400) * 400) AS INTEGER) AS ymin, CAST(trunc(xmax + 0.75 + (xmin // 400) * 400) AS INTEGER) AS xmax, CAST(trunc(ymax + 0.75 + (ymin // 400) * 400) AS INTEGER) AS ymax FROM det", DET_SQL)
def translate_boxes(spark, sf):
    d = _windowed(det(spark, sf), ["xmin", "ymin", "xmax", "ymax"])
    d = d.withColumns({c: F.col(c) + 0.75 for c in ("xmin", "ymin", "xmax", "ymax")})
    return suppress.translate(d).select(*_ID, "xmin", "ymin", "xmax", "ymax")


@query("SELECT ann_id, image_path, x * 300 / 1200 AS x, y * 300 / 1200 AS y FROM pts", PTS_SQL)
def scale_points(spark, sf):
    p = pts(spark, sf)
    frames = p.select("image_path").distinct().withColumns({"width": F.lit(1200), "height": F.lit(1200)})
    return coords.scale_points(p, frames).select(*_ID, "x", "y")


@query("SELECT ann_id, image_path, x + (x // 400) * 400 AS x, y + (y // 400) * 400 AS y FROM pts", PTS_SQL)
def translate_points(spark, sf):
    return suppress.translate(_windowed(pts(spark, sf), ["x", "y"])).select(*_ID, "x", "y")


@query("SELECT ann_id, CAST(round_even(xmin / 2, 0) AS INTEGER) AS x FROM det", DET_SQL)
def round_half_even(spark, sf):
    return det(spark, sf).select("ann_id", boxes.round_half_even(F.col("xmin") / 2).alias("x"))


@query("SELECT ann_id, concat(image_path, '_', ann_id % 10, '.png') AS crop FROM det", DET_SQL)
def crop_names(spark, sf):
    return det(spark, sf).select("ann_id", boxes.crop_name(F.concat(F.lit("/a/b.c/"), "image_path", F.lit(".tif")), F.col("ann_id") % 10).alias("crop"))


@query("SELECT ann_id, CASE xmin % 4 WHEN 0 THEN 'Tree' WHEN 1 THEN 'Bird' ELSE CAST(xmin % 4 AS VARCHAR) END AS label FROM det", DET_SQL)
def decode_labels(spark, sf):
    return det(spark, sf).select("ann_id", boxes.decode_label(F.col("xmin") % 4, {0: "Tree", 1: "Bird"}).alias("label"))


@query("SELECT ann_id, CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS label FROM det", DET_SQL)
def encode_labels(spark, sf):
    return det(spark, sf).select("ann_id", readers.encode_label(F.col("label"), _LABELS).alias("label"))


def _square_axis(lo: str, hi: str, most: int, limit: int) -> str:
    return f"CASE WHEN least(side, {limit}) > {most} THEN 0.0 ELSE greatest(least(({lo} + {hi}) / 2 - side / 2, {most} - side), 0.0) END"


@query(f"SELECT ann_id, x AS xmin, y AS ymin, x + least(side, 1000, 90) AS xmax, y + least(side, 1000, 90) AS ymax FROM (SELECT *, {_square_axis('xmin', 'xmax', 1000, 1000)} AS x, {_square_axis('ymin', 'ymax', 90, 1000)} AS y FROM (SELECT *, CAST(greatest(xmax - xmin, ymax - ymin) AS DOUBLE) AS side FROM det))", DET_SQL)
def square_boxes(spark, sf):
    """In images of 1000 x 90 pixels, so that some sides are over the height."""
    b = boxes.square(boxes.box(), F.lit(1000.0), F.lit(90.0))
    return det(spark, sf).select("ann_id", *(v.alias(c) for c, v in zip(("xmin", "ymin", "xmax", "ymax"), b, strict=True)))


@query("SELECT ann_id, greatest(xmin - 15, 0) AS x, greatest(ymin - 15, 0) AS y, greatest(least(xmax + 15, 1000) - greatest(xmin - 15, 0), 1) AS w, greatest(least(ymax + 15, 1000) - greatest(ymin - 15, 0), 1) AS h FROM det", DET_SQL)
def expand_boxes(spark, sf):
    b = boxes.expand(boxes.box(), 15, F.lit(1000), F.lit(1000))
    return det(spark, sf).select("ann_id", *(v.alias(c) for c, v in zip("xywh", b, strict=True)))


@query("SELECT ann_id, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h, (xmax - xmin) * (ymax - ymin) AS area, 0 AS iscrowd FROM det", DET_SQL)
def coco_boxes(spark, sf):
    return det(spark, sf).select("ann_id", F.col("xmin").alias("x"), F.col("ymin").alias("y"), (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"), boxes.area(boxes.box()).alias("area"), F.lit(0).alias("iscrowd"))


@query("SELECT ann_id, CAST(floor((x / 10.0 + 180.0) / 360.0 * 1024) AS BIGINT) AS tx, CAST(floor((1.0 - asinh(tan(radians(y / 10.0))) / pi()) / 2.0 * 1024) AS BIGINT) AS ty FROM pts", PTS_SQL)
def tile_numbers(spark, sf):
    tx, ty = boxes.tile_numbers(F.col("y") / 10.0, F.col("x") / 10.0, 10)
    return pts(spark, sf).select("ann_id", F.floor(tx).alias("tx"), F.floor(ty).alias("ty"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS label, list_max(embedding) AS score FROM embeddings")
def argmax_score(spark, sf):
    return evaluate.best_class(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"), "embedding").select("vec_id", "label", "score")


@query("SELECT DISTINCT image_path FROM det", DET_SQL)
def distinct_images(spark, sf):
    return det(spark, sf).select("image_path").distinct()


@query("SELECT ann_id, 1200 - xmax AS xmin, ymin, 1200 - xmin AS xmax, ymax FROM det", DET_SQL)
def flip_boxes(spark, sf):
    return augment.flip(det(spark, sf), images(spark, sf)).select("ann_id", "xmin", "ymin", "xmax", "ymax")


@query("SELECT ann_id, xmin, 1200 - ymax AS ymin, xmax, 1200 - ymin AS ymax FROM det", DET_SQL)
def flip_boxes_vertically(spark, sf):
    return augment.flip(det(spark, sf), images(spark, sf), False).select("ann_id", "xmin", "ymin", "xmax", "ymax")


@query("SELECT ann_id, ymin AS xmin, 1200 - xmax AS ymin, ymax AS xmax, 1200 - xmin AS ymax FROM det", DET_SQL)
def rotate_boxes(spark, sf):
    return augment.rotate_quarter(det(spark, sf), images(spark, sf)).select("ann_id", "xmin", "ymin", "xmax", "ymax")


@query("SELECT * FROM (SELECT ann_id, least(greatest(xmin - 200, 0), 500) + 16 AS xmin, least(greatest(ymin - 100, 0), 400) + 8 AS ymin, least(greatest(xmax - 200, 0), 500) + 16 AS xmax, least(greatest(ymax - 100, 0), 400) + 8 AS ymax FROM (SELECT ann_id, 1200 - xmax AS xmin, ymin, 1200 - xmin AS xmax, ymax FROM det)) WHERE xmax - xmin >= 1 AND ymax - ymin >= 1", DET_SQL)
def augmented_boxes(spark, sf):
    """Named steps in any order: flip, then crop, then padding."""
    run = augment.get_transform([("Pad", {"left": 16, "top": 8}), ("Crop", {"x": 200, "y": 100, "width": 500, "height": 400}), ("HorizontalFlip", {})])
    return run(det(spark, sf), images(spark, sf)).select("ann_id", "xmin", "ymin", "xmax", "ymax")


@query('SELECT ann_id, CAST(floor(x0) AS INTEGER) AS x, CAST(floor(y0) AS INTEGER) AS y, CAST(x1 - floor(x0) AS INTEGER) AS w, CAST(y1 - floor(y0) AS INTEGER) AS h FROM (SELECT ann_id, xmin AS x0, ymin AS y0, least(xmax, 1200) AS x1, least(ymax, 1200) AS y1 FROM det)', DET_SQL)
def crop_windows(spark, sf):
    """Pixel windows of projected bounds."""
    d = coords.image_to_geo(det(spark, sf), images(spark, sf), 0.0).join(images(spark, sf), "image_path")
    w = boxes.crop_window(boxes.box(), F.col("left"), F.col("top"), F.col("res"), F.col("width"), F.col("height"))
    return d.select("ann_id", *(v.alias(c) for c, v in zip("xywh", w, strict=True)))


@query('SELECT ann_id, ROUND("left" + (x + 0.5) * 0.1, 6) AS x, ROUND(-(top - (y + 0.5) * 0.1), 6) AS y FROM pts JOIN frames USING (image_path)', PTS_SQL, """frames AS (SELECT image_path, 10.0 * CAST(substr(image_path, 5) AS INTEGER) AS "left", 20.0 * CAST(substr(image_path, 5) AS INTEGER) AS top FROM (SELECT DISTINCT image_path FROM pts))""")
def points_to_geo_flipped(spark, sf):
    p = pts(spark, sf)
    k = F.substring("image_path", 5, 9).cast("int")
    frames = p.select("image_path").distinct().withColumns({"left": 10.0 * k, "top": 20.0 * k, "res": F.lit(0.1)})
    return coords.image_to_geo(p, frames, flip_y_axis=True).select("ann_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query('SELECT ann_id, ROUND((1000.0 + x - 10.0 * k) / 0.5, 6) AS x, ROUND((20.0 * k - y) / 0.5, 6) AS y FROM (SELECT *, CAST(substr(image_path, 5) AS INTEGER) AS k FROM pts)', PTS_SQL)
def points_from_geo(spark, sf):
    """Each image's points by its own bounds."""
    p = pts(spark, sf).withColumn("x", F.col("x") + 1000.0)
    k = F.substring("image_path", 5, 9).cast("int")
    frames = p.select("image_path").distinct().withColumns({"left": 10.0 * k, "top": 20.0 * k, "res": F.lit(0.5)})
    return coords.points_geo_to_image(p, frames).select("ann_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT ann_id, image_path, x * (1202 / 300) AS x, y * (1202 / 300) AS y FROM pts", PTS_SQL)
def unscale_points(spark, sf):
    p = pts(spark, sf)
    frames = p.select("image_path").distinct().withColumns({"width": F.lit(1202), "height": F.lit(1202)})
    return coords.unscale_points(p, frames).select(*_ID, "x", "y")


# Polygons: each box cut to an octagon would need geometry in SQL; boxes as polygons have the boxes' own answers.


def _polygons(d: DataFrame) -> DataFrame:
    p = lambda x, y: F.concat(F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"))
    corners = F.concat_ws(", ", p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))
    parsed = d.withColumn("rings", polygons.parse_wkt(F.concat(F.lit("POLYGON (("), corners, F.lit("))")))).drop("xmin", "ymin", "xmax", "ymax")
    return written(parsed, "polygons")  # parsed once, not in every expression over it


@query("SELECT ann_id, CAST((xmax - xmin) * (ymax - ymin) AS DOUBLE) AS area, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y, CAST(xmin AS DOUBLE) AS xmin, CAST(ymax AS DOUBLE) AS ymax FROM det", DET_SQL)
def polygon_measures(spark, sf):
    d = polygons.with_bounds(_polygons(det(spark, sf)))
    x, y = polygons.centroid(F.slice(F.col("rings")[0][0], 1, 4))
    return d.select("ann_id", polygons.area(F.col("rings")).alias("area"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), "xmin", "ymax")


@query("SELECT ann_id, image_path, concat(CASE WHEN xmax > 1000 THEN 'xmax > width;' ELSE '' END, CASE WHEN ymax > 1000 THEN 'ymax > height;' ELSE '' END) AS issues FROM det WHERE xmax > 1000 OR ymax > 1000", DET_SQL)
def polygon_issues(spark, sf):
    small = images(spark, sf).select("image_path", F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return polygons.polygon_issues(_polygons(det(spark, sf)), small).withColumn("issues", F.array_join(F.transform("issues", lambda x: F.concat(x, F.lit(";"))), ""))


@query("SELECT image_path, window_index, ann_id, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax FROM cut", DET_SQL, IMAGES_SQL, "win AS (SELECT image_path, CAST(i * 4 + j AS INTEGER) AS window_index, s[i + 1] AS window_xmin, s[j + 1] AS window_ymin FROM images, (SELECT [0, 380, 760, 800] AS s), range(4) AS a(i), range(4) AS b(j))", """cut AS (SELECT image_path, window_index, ann_id, greatest(xmin, window_xmin) - window_xmin AS xmin, greatest(ymin, window_ymin) - window_ymin AS ymin,
  least(xmax, window_xmin + 400) - window_xmin AS xmax, least(ymax, window_ymin + 400) - window_ymin AS ymax FROM det JOIN win USING (image_path)
  WHERE xmin < window_xmin + 400 AND xmax > window_xmin AND ymin < window_ymin + 400 AND ymax > window_ymin
  AND (least(xmax, window_xmin + 400) - greatest(xmin, window_xmin)) * (least(ymax, window_ymin + 400) - greatest(ymin, window_ymin)) > 0.5 * (xmax - xmin) * (ymax - ymin))""")
def polygons_per_window(spark, sf):
    out = polygons.per_window(_polygons(det(spark, sf)).select("ann_id", "image_path", "rings"), tiling.windows(images(spark, sf)))
    return out.select("image_path", "window_index", "ann_id", *(F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


# Filters and checks


@query(f"SELECT ann_id, image_path, {_BOX} FROM framed WHERE NOT (xmin = 0 AND ymin = 0 AND xmax = 0 AND ymax = 0)", DET_SQL, EMPTY_SQL)
def drop_empty_frames(spark, sf):
    return validate.drop_empty(with_empty(det(spark, sf))).select(*_ID, "xmin", "ymin", "xmax", "ymax")


@query(f"SELECT ann_id, image_path, {_BOX} FROM framed WHERE xmin <> xmax AND ymin <> ymax", DET_SQL, EMPTY_SQL)
def drop_degenerate(spark, sf):
    return validate.drop_degenerate(with_empty(det(spark, sf))).select(*_ID, "xmin", "ymin", "xmax", "ymax")


@query("SELECT * FROM (SELECT ann_id, least(greatest(xmin, 0), 900) AS xmin, least(greatest(ymin, 0), 900) AS ymin, least(greatest(xmax, 0), 900) AS xmax, least(greatest(ymax, 0), 900) AS ymax FROM det) WHERE xmax - xmin >= 1 AND ymax - ymin >= 1", DET_SQL)
def clamp_boxes(spark, sf):
    return validate.clamp_boxes(det(spark, sf), F.lit(900), F.lit(900)).select("ann_id", "xmin", "ymin", "xmax", "ymax")


@query("SELECT ann_id, x, y FROM pts WHERE x BETWEEN 0 AND 700 AND y BETWEEN 0 AND 500", PTS_SQL)
def points_in_image(spark, sf):
    return validate.points_in_image(pts(spark, sf), F.lit(700), F.lit(500)).select("ann_id", "x", "y")


@query("SELECT ann_id, score FROM det WHERE score > 30000", DET_SQL)
def score_filter(spark, sf):
    return validate.score_filter(det(spark, sf), 30000).select("ann_id", "score")


@query("SELECT DISTINCT label FROM det WHERE label NOT IN ('A', 'N')", DET_SQL)
def missing_labels(spark, sf):
    return validate.missing_labels(det(spark, sf), spark.createDataFrame([("A",), ("N",)], "label string"))


@query("SELECT ann_id, image_path, concat(CASE WHEN xmax > 1000 THEN 'xmax > width;' ELSE '' END, CASE WHEN ymax > 1000 THEN 'ymax > height;' ELSE '' END) AS issues FROM det WHERE xmax > 1000 OR ymax > 1000", DET_SQL)
def box_issues(spark, sf):
    small = images(spark, sf).withColumns({"width": F.lit(1000), "height": F.lit(1000)}).select("image_path", "width", "height")
    return validate.box_issues(det(spark, sf), small).withColumn("issues", F.array_join(F.transform("issues", lambda x: F.concat(x, F.lit(";"))), ""))


@query("SELECT ann_id, image_path, concat(CASE WHEN x > 900 THEN 'x outside;' ELSE '' END, CASE WHEN y > 700 THEN 'y outside;' ELSE '' END) AS issues FROM pts WHERE x > 900 OR y > 700", PTS_SQL)
def point_issues(spark, sf):
    p = pts(spark, sf)
    small = p.select("image_path").distinct().withColumns({"width": F.lit(900), "height": F.lit(700)})
    return validate.point_issues(p, small).withColumn("issues", F.array_join(F.transform("issues", lambda x: F.concat(x, F.lit(";"))), ""))


@query("SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM det", DET_SQL)
def total_bounds(spark, sf):
    return validate.total_bounds(det(spark, sf))


# Tiling. Windows of 400 with an overlap of 20 over 1200: starts 0, 380, 760, 800.

_WIN_SQL = "win AS (SELECT image_path, CAST(i * 4 + j AS INTEGER) AS window_index, s[i + 1] AS window_xmin, s[j + 1] AS window_ymin, 400 AS window_w, 400 AS window_h FROM images, (SELECT [0, 380, 760, 800] AS s), range(4) AS a(i), range(4) AS b(j))"
_CUT_SQL = f"""cut AS (SELECT image_path, window_index, ann_id, label, score, greatest(xmin, window_xmin) - window_xmin AS xmin, greatest(ymin, window_ymin) - window_ymin AS ymin,
  least(xmax, window_xmin + 400) - window_xmin AS xmax, least(ymax, window_ymin + 400) - window_ymin AS ymax FROM det JOIN win USING (image_path)
  WHERE xmin < window_xmin + 400 AND xmax > window_xmin AND ymin < window_ymin + 400 AND ymax > window_ymin
  AND (least(xmax, window_xmin + 400) - greatest(xmin, window_xmin)) * (least(ymax, window_ymin + 400) - greatest(ymin, window_ymin)) > 0.5 * (xmax - xmin) * (ymax - ymin))"""
_TILES = (DET_SQL, IMAGES_SQL, _WIN_SQL, _CUT_SQL)


@query("SELECT * FROM win", IMAGES_SQL, _WIN_SQL)
def windows(spark, sf):
    return tiling.windows(images(spark, sf))


@query("SELECT image_path, CAST(j * 4 + i AS INTEGER) AS window_index, CAST(i * 380 AS INTEGER) AS window_xmin, CAST(j * 380 AS INTEGER) AS window_ymin, 400 AS window_w, 400 AS window_h FROM images, range(4) AS a(i), range(4) AS b(j)", IMAGES_SQL)
def windows_padded(spark, sf):
    return tiling.windows_padded(images(spark, sf))


@query(f"SELECT image_path, window_index, ann_id, {_BOX} FROM cut", *_TILES)
def annotations_per_window(spark, sf):
    return tiling.annotations_per_window(det(spark, sf), tiling.windows(images(spark, sf))).select("image_path", "window_index", "ann_id", "xmin", "ymin", "xmax", "ymax")


@query(f"SELECT concat(image_path, '_', window_index, '.png') AS image_path, label, {_BOX} FROM cut UNION ALL SELECT concat(image_path, '_', window_index, '.png'), 'A', 0, 0, 0, 0 FROM win ANTI JOIN cut USING (image_path, window_index)", *_TILES)
def split_annotations(spark, sf):
    return tiling.split_annotations(det(spark, sf), tiling.windows(images(spark, sf)), allow_empty=True, empty_label="A")


# Images of 2400 x 1200 here: boxes reach to 1140 only, so many windows are empty.
_WIDE_SQL = """wide AS (SELECT image_path, CAST(i * 4 + j AS INTEGER) AS window_index, s[i + 1] AS window_xmin, t[j + 1] AS window_ymin FROM images, (SELECT [0, 380, 760, 1140, 1520, 1900, 2000] AS s, [0, 380, 760, 800] AS t), range(7) AS a(i), range(4) AS b(j)),
  full_ AS (SELECT DISTINCT image_path, window_index FROM det JOIN wide USING (image_path) WHERE xmin < window_xmin + 400 AND xmax > window_xmin AND ymin < window_ymin + 400 AND ymax > window_ymin
    AND (least(xmax, window_xmin + 400) - greatest(xmin, window_xmin)) * (least(ymax, window_ymin + 400) - greatest(ymin, window_ymin)) > 0.5 * (xmax - xmin) * (ymax - ymin))"""


@query("SELECT image_path, window_index FROM wide EXCEPT SELECT image_path, window_index FROM full_", DET_SQL, IMAGES_SQL, _WIDE_SQL)
def empty_windows(spark, sf):
    frames = images(spark, sf).withColumn("width", F.lit(2400))
    return tiling.empty_windows(det(spark, sf), tiling.windows(frames)).select("image_path", "window_index")


@query("SELECT image_path FROM det GROUP BY 1 HAVING max(xmax) > 1.1 * 1000 OR max(ymax) > 1.1 * 1000", DET_SQL)
def outside_rasters(spark, sf):
    small = images(spark, sf).select("image_path", F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return validate.outside_rasters(det(spark, sf), small)


@query("SELECT image_path FROM det WHERE CAST(substr(image_path, 5) AS INTEGER) % 7 = 0 GROUP BY 1", DET_SQL)
def empty_images(spark, sf):
    """Every seventh image has empty frames only."""
    bare = F.substring("image_path", 5, 9).cast("int") % 7 == 0
    return validate.empty_images(det(spark, sf).withColumns({c: F.when(bare, 0).otherwise(F.col(c)) for c in ("xmin", "ymin", "xmax", "ymax")}))


@query("SELECT ann_id, CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS label FROM det WHERE image_path = 'img_7'", DET_SQL)
def annotations_for_path(spark, sf):
    return validate.annotations_for_path(det(spark, sf), "img_7", _LABELS).select("ann_id", "label")


@query("SELECT ann_id, label FROM pts WHERE label <> 'click'", PTS_SQL)
def drop_missing(spark, sf):
    rows = pts(spark, sf).withColumn("label", F.when(F.col("label") != "click", F.col("label")))
    return validate.drop_missing(rows, "label").select("ann_id", "label")


# Joins and matching

_PAIR_SQL = """pairs AS (SELECT *, inter / (t_area + p_area - inter) AS iou FROM (SELECT t.image_path, t.ann_id AS t_ann_id, p.ann_id AS p_ann_id, t.label AS t_label, p.label AS p_label,
  (t.xmax - t.xmin) * (t.ymax - t.ymin) AS t_area, (p.xmax - p.xmin) * (p.ymax - p.ymin) AS p_area,
  (least(t.xmax, p.xmax) - greatest(t.xmin, p.xmin)) * (least(t.ymax, p.ymax) - greatest(t.ymin, p.ymin)) AS inter
  FROM det t JOIN det p ON t.image_path = p.image_path AND t.is_truth AND NOT p.is_truth AND t.xmin < p.xmax AND p.xmin < t.xmax AND t.ymin < p.ymax AND p.ymin < t.ymax))"""
_ONE_SQL = "one AS (SELECT * FROM pairs WHERE t_ann_id IN (SELECT t_ann_id FROM pairs GROUP BY 1 HAVING count(*) = 1) AND p_ann_id IN (SELECT p_ann_id FROM pairs GROUP BY 1 HAVING count(*) = 1))"
_MATCH = (DET_SQL, _PAIR_SQL, _ONE_SQL)
_PER_SQL = """per AS (SELECT image_path, n_truth, coalesce(n_pred, 0) AS n_pred, coalesce(n_match, 0) AS n_match, coalesce(n_match, 0) / n_truth AS recall,
  CASE WHEN n_pred > 0 THEN coalesce(n_match, 0) / n_pred END AS "precision" FROM (SELECT image_path, count(*) AS n_truth FROM det WHERE is_truth GROUP BY 1)
  LEFT JOIN (SELECT image_path, count(*) AS n_pred FROM det WHERE NOT is_truth GROUP BY 1) USING (image_path)
  LEFT JOIN (SELECT image_path, count(*) AS n_match FROM one WHERE iou > 0.4 GROUP BY 1) USING (image_path))"""


def _pairs(spark, sf) -> DataFrame:
    d = det(spark, sf).drop("l_discount")
    return matching.iou_pairs(_truth(d), _pred(d))


def _unique(spark, sf) -> DataFrame:
    d = det(spark, sf).drop("l_discount")
    return overlaps.unique_pairs(_truth(d), _pred(d)).select("image_path", "t_ann_id", "p_ann_id", "t_label", "p_label", "iou")


def _best(spark, sf) -> DataFrame:
    d = det(spark, sf)
    return overlaps.best_overlaps(_truth(d), _pred(d))


def _per_image(spark, sf) -> DataFrame:
    d = det(spark, sf)
    return evaluate.image_recall_precision(_truth(d), _pred(d), _unique(spark, sf).where("iou > 0.4"))


@query("SELECT image_path, t_ann_id, p_ann_id, inter, iou FROM pairs", DET_SQL, _PAIR_SQL)
def box_iou_pairs(spark, sf):
    d = det(spark, sf)
    return overlaps.iou_rows(_truth(d), _pred(d))


@query("SELECT p.ann_id, p.image_path, d.ann_id AS t_ann_id FROM pts p LEFT JOIN det d ON p.image_path = d.image_path AND p.x > d.xmin AND p.x < d.xmax AND p.y > d.ymin AND p.y < d.ymax", DET_SQL, PTS_SQL)
def points_in_boxes(spark, sf):
    return matching.points_in_boxes(pts(spark, sf), det(spark, sf)).select("ann_id", "image_path", "t_ann_id")


@query("SELECT image_path, t_ann_id, p_ann_id, iou FROM one", *_MATCH)
def match_boxes_unique(spark, sf):
    return _unique(spark, sf).select("image_path", "t_ann_id", "p_ann_id", "iou")


@query()
def match_boxes(spark, sf):
    d = det(spark, sf)
    return matching.match_boxes(_truth(d), _pred(d))


@query("SELECT image_path, t_ann_id, p_ann_id, CAST(inter AS DOUBLE) AS inter, ROUND(iou, 9) AS iou FROM pairs", DET_SQL, _PAIR_SQL)
def polygon_overlaps(spark, sf):
    d = _polygons(det(spark, sf))
    return polygons.overlap_pairs(_truth(d), _pred(d)).withColumns({"inter": F.round("inter", 6), "iou": F.round("iou", 9)})


@query()
def match_polygons(spark, sf):
    d = _polygons(det(spark, sf))
    return polygons.match_polygons(_truth(d), _pred(d))


@query("SELECT o.image_path, t_ann_id AS truth_id, p_ann_id AS prediction_id, d.xmin, d.ymin, d.xmax, d.ymax FROM one o JOIN det d ON d.ann_id = t_ann_id AND d.is_truth", *_MATCH)
def truth_geometry(spark, sf):
    rows = _unique(spark, sf).select("image_path", F.col("t_ann_id").alias("truth_id"), F.col("p_ann_id").alias("prediction_id"))
    return matching.with_truth(rows, _truth(det(spark, sf))).select("image_path", "truth_id", "prediction_id", "xmin", "ymin", "xmax", "ymax")


@query("SELECT ann_id, CASE WHEN ann_id % 3 > 0 THEN 'A' END AS cropmodel_label_0, CASE WHEN ann_id % 3 > 0 THEN 0.5::DOUBLE END AS cropmodel_score_0, l AS cropmodel_label_1, s AS cropmodel_score_1 FROM det JOIN (SELECT ann_id, min(label) AS l, min(score) AS s FROM det GROUP BY 1) USING (ann_id)", DET_SQL)
def attach_crop_results(spark, sf):
    """Two models' results, the first for two thirds of the rows only."""
    d = det(spark, sf)
    two = d.groupBy("ann_id").agg(F.min("label").alias("label"), F.min("score").alias("score"))
    one = two.where("ann_id % 3 > 0").select("ann_id", F.lit("A").alias("label"), F.lit(0.5).alias("score"))
    return evaluate.attach_crop_results(d.select("ann_id"), one, two)


@query()
def match_points(spark, sf):
    p = pts(spark, sf)
    return matching.match_points(_truth(p), _pred(p))


@query("SELECT ann_id, image_path, width, height FROM det JOIN images USING (image_path)", DET_SQL, IMAGES_SQL)
def image_lookup(spark, sf):
    return det(spark, sf).join(images(spark, sf), "image_path").select("ann_id", "image_path", "width", "height")


# Suppression


def _nms_sql(by: str, name: str = "preds", threshold: float = 0.15) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, ann_id) AS rk, concat_ws('|', {by}) AS g FROM {name}),
  hits AS (SELECT a.g, b.rk AS j, list(a.rk) AS above FROM ranked a JOIN ranked b ON a.g = b.g AND a.rk < b.rk AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax
    WHERE ((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)))
      / ((a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) - (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))) > {threshold} GROUP BY 1, 2),
  {_WALK_SQL}"""


_WALK_SQL = """sizes AS (SELECT g, max(rk) AS n FROM ranked GROUP BY 1),
  walk AS (SELECT g, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM sizes UNION ALL
    SELECT w.g, w.rk + 1, CASE WHEN h.above IS NULL OR NOT list_has_any(w.kept, h.above) THEN list_append(w.kept, w.rk + 1) ELSE w.kept END
    FROM walk w JOIN sizes s ON w.g = s.g AND w.rk < s.n LEFT JOIN hits h ON h.g = w.g AND h.j = w.rk + 1),
  keep AS (SELECT w.g, unnest(w.kept) AS rk FROM walk w JOIN sizes s ON w.g = s.g AND w.rk = s.n)"""
_PREDS_SQL = "preds AS (SELECT * FROM det WHERE NOT is_truth)"
_KEPT = f"SELECT ann_id, image_path, {_BOX}, label, score FROM ranked JOIN keep USING (g, rk)"


@query(_KEPT, DET_SQL, _PREDS_SQL, _nms_sql("image_path"))
def nms_boxes(spark, sf):
    return suppress.nms(_pred(det(spark, sf)).select(*_ROW), 0.15)


@query(_KEPT, DET_SQL, _PREDS_SQL, _nms_sql("image_path", threshold=0.05))
def nms_across_classes(spark, sf):
    return suppress.nms_across_classes(_pred(det(spark, sf)).select(*_ROW))


@query(_KEPT, DET_SQL, _PREDS_SQL, _nms_sql("image_path, label"))
def nms_per_class(spark, sf):
    return suppress.nms(_pred(det(spark, sf)).select(*_ROW), 0.15, by=("image_path", "label"))


@query(_KEPT, DET_SQL, "preds AS (SELECT * REPLACE (xmin + (xmin // 400) * 400 AS xmin, ymin + (ymin // 400) * 400 AS ymin, xmax + (xmin // 400) * 400 AS xmax, ymax + (ymin // 400) * 400 AS ymax) FROM det WHERE NOT is_truth)", _nms_sql("image_path"))
def mosaic_boxes(spark, sf):
    d = _windowed(_pred(det(spark, sf)).select(*_ROW), ["xmin", "ymin", "xmax", "ymax"])
    return suppress.mosaic(d, threshold=0.15).select(*_ROW)


@query("SELECT ann_id, image_path, x, y, label, score FROM ranked JOIN keep USING (g, rk)", PTS_SQL, f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY score DESC, ann_id) AS rk, image_path AS g FROM pts WHERE NOT is_truth),
  hits AS (SELECT a.g, b.rk AS j, list(a.rk) AS above FROM ranked a JOIN ranked b ON a.g = b.g AND a.rk < b.rk AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 GROUP BY 1, 2), {_WALK_SQL}""")
def suppress_points(spark, sf):
    return suppress.suppress_points(_pred(pts(spark, sf)), 30.0).select("ann_id", "image_path", "x", "y", "label", "score")


@query(f"SELECT ann_id, image_path, {_BOX}, CASE label WHEN 'A' THEN 'Alive' ELSE label END AS label, score FROM ranked JOIN keep USING (g, rk) UNION ALL SELECT ann_id, image_path, {_BOX}, CASE label WHEN 'A' THEN 'Alive' ELSE label END, score FROM det WHERE NOT is_truth AND image_path NOT IN (SELECT image_path FROM mixed)", DET_SQL, "mixed AS (SELECT image_path FROM det WHERE NOT is_truth GROUP BY 1 HAVING count(DISTINCT label) > 1)", "preds AS (SELECT * FROM det WHERE NOT is_truth AND image_path IN (SELECT image_path FROM mixed))", _nms_sql("image_path"))
def predict_file_boxes(spark, sf):
    """What follows the scorer: suppression where an image has several classes, and decoded labels."""
    found = suppress.nms_where_classes_mix(_pred(det(spark, sf)).select(*_ROW), 0.15)
    return found.withColumn("label", boxes.decode_label(F.col("label"), {"A": "Alive"})).select(*_ROW)


@query(f"SELECT ann_id, image_path, {_BOX}, label, score FROM det QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY score DESC, ann_id) <= 20", DET_SQL)
def topk_per_image(spark, sf):
    return suppress.top_k(det(spark, sf), 20).select(*_ROW)


# Aggregates


@query("SELECT * FROM per", *_MATCH, _PER_SQL)
def image_recall_precision_unique(spark, sf):
    return _per_image(spark, sf)


@query('SELECT ROUND(avg(recall), 9) AS recall, ROUND(avg("precision"), 9) AS "precision" FROM per', *_MATCH, _PER_SQL)
def macro_metrics_unique(spark, sf):
    return evaluate.macro(_per_image(spark, sf)).select(F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query('SELECT label, coalesce(h / nt, 0.0) AS recall, coalesce(h / np, 0.0) AS "precision", coalesce(nt, 0) AS size FROM (SELECT t_label AS label, count(*) AS nt FROM m GROUP BY 1) FULL JOIN (SELECT p_label AS label, count(*) AS np FROM m GROUP BY 1) USING (label) LEFT JOIN (SELECT t_label AS label, count(*) AS h FROM m WHERE t_label = p_label GROUP BY 1) USING (label)', *_MATCH, "m AS (SELECT * FROM one WHERE iou > 0.4)")
def class_metrics_unique(spark, sf):
    m = _unique(spark, sf).where("iou > 0.4").select(F.col("t_label").alias("true_label"), F.col("p_label").alias("predicted_label"))
    return evaluate.class_metrics(m)


@query('SELECT n + e AS n_images, ROUND(rs, 9) AS recall_sum, n AS recall_images, ROUND(ps, 9) AS precision_sum, pn + ew AS precision_images, e AS empty_images, e - ew AS empty_correct FROM (SELECT count(*) AS n, sum(recall) AS rs, sum("precision") AS ps, count("precision") AS pn FROM per), (SELECT count(*) AS e, count(*) FILTER (image_path IN (SELECT image_path FROM det WHERE NOT is_truth AND score > 95000)) AS ew FROM (SELECT DISTINCT image_path FROM det WHERE is_truth AND l_discount = 0))', *_MATCH, _PER_SQL)
def metric_counters_unique(spark, sf):
    d = det(spark, sf)
    out = evaluate.counters(_per_image(spark, sf), _truth(d).where("l_discount = 0"), _pred(d).where("score > 95000"))
    return out.withColumns({c: F.round(c, 9) for c in ("recall_sum", "precision_sum")})


@query("SELECT image_path, coalesce(pred_count, 0) AS pred_count, ROUND(mean, 6) AS mean, max, min, ROUND(std, 6) AS std, coalesce(gt_count, 0) AS gt_count FROM (SELECT image_path, count(*) AS pred_count, avg(score) AS mean, max(score) AS max, min(score) AS min, stddev_samp(score) AS std FROM det WHERE NOT is_truth GROUP BY 1) FULL JOIN (SELECT image_path, count(*) AS gt_count FROM det WHERE is_truth GROUP BY 1) USING (image_path)", DET_SQL)
def score_stats(spark, sf):
    d = det(spark, sf)
    return evaluate.score_stats(_pred(d), _truth(d)).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT avg(abs(n)) AS count_mae FROM (SELECT image_path, sum(CASE WHEN is_truth THEN 1 ELSE -1 END) AS n FROM pts GROUP BY 1)", PTS_SQL)
def count_mae(spark, sf):
    p = pts(spark, sf)
    return evaluate.count_mae(_pred(p), _truth(p))


@query("SELECT ROUND(avg(abs(ln(1 + p) - ln(1 + t))), 9) AS count_log_mae FROM (SELECT image_path, count(*) FILTER (NOT is_truth) AS p, count(*) FILTER (is_truth) AS t FROM pts GROUP BY 1)", PTS_SQL)
def count_log_mae(spark, sf):
    p = pts(spark, sf)
    return evaluate.count_log_mae(_pred(p), _truth(p)).select(F.round("count_log_mae", 9).alias("count_log_mae"))


@query("SELECT ROUND(avg(coalesce(iou, 0)), 9) AS iou FROM det LEFT JOIN (SELECT t_ann_id AS ann_id, max(iou) AS iou FROM pairs GROUP BY 1) USING (ann_id) WHERE is_truth", DET_SQL, _PAIR_SQL)
def mean_iou(spark, sf):
    return evaluate.mean_iou(_best(spark, sf), _truth(det(spark, sf))).select(F.round("iou", 9).alias("iou"))


_CROP = "c AS (SELECT label AS true_label, CASE WHEN ann_id % 7 = 0 THEN 'A' ELSE label END AS predicted_label FROM det)"


def _labelled(spark, sf) -> DataFrame:
    return det(spark, sf).select(F.col("label").alias("true_label"), F.when(F.col("ann_id") % 7 == 0, "A").otherwise(F.col("label")).alias("predicted_label"))


@query("SELECT true_label, avg(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS accuracy, count(*) AS n FROM c GROUP BY 1", DET_SQL, _CROP)
def crop_accuracy(spark, sf):
    return evaluate.class_accuracy(_labelled(spark, sf))


@query("SELECT true_label, predicted_label, count(*) AS n FROM c GROUP BY 1, 2", DET_SQL, _CROP)
def confusion(spark, sf):
    return evaluate.confusion(_labelled(spark, sf))


@query("SELECT ann_id, label, 1.0::DOUBLE / n AS weight FROM det JOIN (SELECT label, count(*) AS n FROM det GROUP BY 1) USING (label)", DET_SQL)
def class_weights(spark, sf):
    return evaluate.class_weights(det(spark, sf)).select("ann_id", "label", "weight")


@query('SELECT image_path, CAST(least(greatest(round_even(y / 4.0, 0), 0), 149) AS INTEGER) AS "row", CAST(least(greatest(round_even(x / 4.0, 0), 0), 199) AS INTEGER) AS col, count(*) AS n FROM pts GROUP BY 1, 2, 3', PTS_SQL)
def rasterize_points(spark, sf):
    return density.rasterize(pts(spark, sf), 150, 200, 4.0)


@query("SELECT image_path, round_even(count(*), 6) AS total FROM pts GROUP BY 1", PTS_SQL)
def density_totals(spark, sf):
    return density.density(pts(spark, sf).withColumns({"x": F.col("x") / 8, "y": F.col("y") / 8}), 128, 128).groupBy("image_path").agg(F.round(F.sum("value"), 6).alias("total"))


@query()
def average_precision(spark, sf):
    d = det(spark, sf)
    return precision.average_precision(_truth(d), _pred(d))


@query()
def detection_summary(spark, sf):
    d = det(spark, sf)
    return precision.detection_summary(_truth(d), _pred(d))


# The whole evaluation on the real assignment; tests hold it against enumeration.


def _evaluated(spark, sf, task: str) -> dict:
    d = det(spark, sf) if task == "box" else pts(spark, sf) if task == "point" else _polygons(det(spark, sf))
    return evaluate.evaluate(_pred(d), _truth(d), task)


@query()
def evaluate_boxes(spark, sf):
    return _evaluated(spark, sf, "box")["macro"]


@query()
def evaluate_points(spark, sf):
    return _evaluated(spark, sf, "point")["macro"]


@query()
def evaluate_polygons(spark, sf):
    return _evaluated(spark, sf, "polygon")["macro"]


@query()
def image_recall_precision(spark, sf):
    return _evaluated(spark, sf, "box")["per_image"]


@query()
def class_metrics(spark, sf):
    return _evaluated(spark, sf, "box")["class"]


@query()
def metric_counters(spark, sf):
    d = det(spark, sf)
    return evaluate.counters(_evaluated(spark, sf, "box")["per_image"], _truth(d).where("l_discount = 0"), _pred(d).where("score > 95000"))


@query()
def metrics_long(spark, sf):
    return evaluate.metrics_long(_evaluated(spark, sf, "box")["macro"])


@query("SELECT image_path, \"row\", col, ROUND(n / (s + 1e-4), 9) AS normed, ROUND(n / (s + 1e-4) * 2 * s, 9) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY image_path) AS s FROM cells)", PTS_SQL, 'cells AS (SELECT image_path, CAST(least(greatest(round_even(y / 4.0, 0), 0), 149) AS INTEGER) AS "row", CAST(least(greatest(round_even(x / 4.0, 0), 0), 199) AS INTEGER) AS col, count(*) AS n FROM pts GROUP BY 1, 2, 3)')
def normalised_density(spark, sf):
    cells = density.rasterize(pts(spark, sf), 150, 200, 4.0).select("image_path", "row", "col", F.col("n").cast("double").alias("value"))
    counts = cells.groupBy("image_path").agg((F.sum("value") * -2).alias("count"))
    return density.normalise(cells, counts).select("image_path", "row", "col", F.round("normed", 9).alias("normed"), F.round("value", 9).alias("value"))


@query("SELECT ROUND(a, 9) AS accuracy_micro, ROUND(a, 9) AS precision_micro, ROUND(m, 9) AS precision_macro FROM (SELECT avg(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS a FROM c), (SELECT avg(coalesce(p, 0)) AS m FROM (SELECT true_label AS l FROM c UNION SELECT predicted_label FROM c) LEFT JOIN (SELECT predicted_label AS l, avg(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS p FROM c GROUP BY 1) USING (l))", DET_SQL, _CROP)
def label_metrics(spark, sf):
    m = evaluate.label_metrics(_labelled(spark, sf))
    return m.select(*(F.round(c, 9).alias(c) for c in m.columns))


@query("SELECT image_path FROM (SELECT DISTINCT image_path FROM det) ORDER BY 1 LIMIT 20", DET_SQL)
def first_images(spark, sf):
    return sampling.first_images(det(spark, sf).select("image_path").distinct(), 20)


@query("""SELECT ann_id, label, weight, draw FROM (SELECT id AS draw, b, pos - lo AS pos FROM point ASOF JOIN bound ON pos >= lo) p
  ASOF JOIN (SELECT b, ann_id, label, weight, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY e DESC) = 1 THEN 'inf'::DOUBLE ELSE e END AS e FROM placed) r ON p.b = r.b AND p.pos < r.e""", DET_SQL, """weighted AS (SELECT ann_id, label, 1.0::DOUBLE / n AS weight FROM det JOIN (SELECT label, count(*) AS n FROM det GROUP BY 1) USING (label)),
dealt AS (SELECT *, ('0x' || substr(md5('bucket:' || ann_id || ':' || label), 1, 8))::BIGINT % 1024 AS b FROM weighted),
placed AS (SELECT *, sum(weight) OVER (PARTITION BY b ORDER BY ann_id, label ROWS UNBOUNDED PRECEDING) AS e FROM dealt),
bound AS (SELECT b, s, sum(s) OVER (ORDER BY b ROWS UNBOUNDED PRECEDING) - s AS lo FROM (SELECT b, sum(weight) AS s FROM dealt GROUP BY 1)),
point AS (SELECT id, ('0x' || substr(md5('0:' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (SELECT sum(s) FROM bound) AS pos FROM range(0, (SELECT count(*) FROM det)) q(id))""")
def weighted_draws(spark, sf):
    """As many draws as rows, each class as likely as any other."""
    d = evaluate.class_weights(det(spark, sf)).select("ann_id", "label", "weight")
    return sampling.weighted_draws(d, d.count(), ("ann_id", "label"))


# Sets and sinks


@query("SELECT ann_id, image_path, label, score, xmin, NULL::INTEGER AS x FROM det UNION ALL SELECT ann_id, image_path, label, score, NULL, x FROM pts", DET_SQL, PTS_SQL)
def concat_frames(spark, sf):
    a, b = det(spark, sf).select("ann_id", "image_path", "label", "score", "xmin"), pts(spark, sf).select("ann_id", "image_path", "label", "score", "x")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT image_path, ann_id AS window_index, greatest(xmin - 1, 0) AS window_xmin, greatest(ymin - 1, 0) AS window_ymin, least(xmax + 1, 1200) - greatest(xmin - 1, 0) AS window_w, least(ymax + 1, 1200) - greatest(ymin - 1, 0) AS window_h FROM det", DET_SQL)
def raster_crop_windows(spark, sf):
    """Windows of projected bounds that reach a little into the pixels around each box."""
    d = det(spark, sf).join(images(spark, sf).select("image_path", "left", "top", "res"), "image_path")
    x, y = (lambda c, by: F.col("left") + (F.col(c) + by) * F.col("res")), (lambda c, by: F.col("top") - (F.col(c) + by) * F.col("res"))
    bounds = d.select("image_path", F.col("ann_id").alias("window_index"), x("xmin", -0.3).alias("left"), y("ymax", 0.3).alias("bottom"), x("xmax", 0.3).alias("right"), y("ymin", -0.3).alias("top"))
    return rasters.crop_windows(bounds, images(spark, sf))


@query(f"SELECT ann_id AS window_index, image_path, label, CAST(x AS INTEGER) AS window_xmin, CAST(y AS INTEGER) AS window_ymin, xs AS window_w, xs AS window_h FROM (SELECT *, floor({_square_axis('xmin', 'xmax', 1200, 1200)}) AS x, floor({_square_axis('ymin', 'ymax', 1200, 1200)}) AS y, CAST(side AS INTEGER) AS xs FROM (SELECT *, greatest(xmax - xmin, ymax - ymin) AS side FROM det))", DET_SQL)
def label_crop_windows(spark, sf):
    return rasters.label_crops(det(spark, sf), images(spark, sf)).drop("ann_id")


@query("SELECT label FROM det UNION SELECT label FROM pts", DET_SQL, PTS_SQL)
def label_union(spark, sf):
    return evaluate.label_union(det(spark, sf), pts(spark, sf))


@query("SELECT label FROM pts EXCEPT SELECT 'click'", PTS_SQL)
def label_difference(spark, sf):
    return pts(spark, sf).select("label").subtract(spark.createDataFrame([("click",)], "label string"))


@query("UNPIVOT (SELECT ROUND(avg(recall), 9) AS recall, ROUND(avg(\"precision\"), 9) AS \"precision\" FROM per) ON recall, \"precision\" INTO NAME metric VALUE value", *_MATCH, _PER_SQL)
def metrics_long_unique(spark, sf):
    return evaluate.metrics_long(macro_metrics_unique(spark, sf))


@query("SELECT label, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS ordinal FROM (SELECT label, min(ann_id) AS f FROM det GROUP BY 1)", DET_SQL)
def label_ordinal(spark, sf):
    return readers.label_ordinal(det(spark, sf))




# Blocks of rasters


def _point_rasters(spark, sf) -> str:
    """A raster for each image of pts, whose cells count its points, in the shared folder."""
    p = pts(spark, sf)
    path = f"{shared_dir(spark)}/rasters-{uuid.uuid4().hex}"
    images_ = p.select("image_path").distinct().select("image_path", F.lit(1000).alias("width"), F.lit(777).alias("height"), F.lit(10.0).alias("left"), F.lit(500.0).alias("top"), F.lit(0.5).alias("res"))
    tiff.write_points(p, images_, path, 128)
    return path


@query("""SELECT concat(i.image_path, '.tif') AS image_path, CAST(x0 + y0 // 100 AS BIGINT) AS window_index, count(x) AS n FROM (SELECT DISTINCT image_path FROM pts) i
  CROSS JOIN (SELECT * FROM range(0, 1000, 100) a(x0), range(0, 800, 100) b(y0)) LEFT JOIN pts ON pts.image_path = i.image_path AND x >= x0 AND x < x0 + 150 AND y >= y0 AND y < y0 + 90 GROUP BY ALL""", PTS_SQL)
def raster_windows(spark, sf):
    """Sums of pixels over windows that reach beyond the raster, read by blocks from files that tasks write."""
    path = _point_rasters(spark, sf)
    wins = tiff.layouts(spark, path).select("image_path", F.explode(F.sequence(F.lit(0), F.lit(900), F.lit(100))).alias("window_xmin")).select("*", F.explode(F.sequence(F.lit(0), F.lit(700), F.lit(100))).alias("window_ymin"))
    wins = wins.select("image_path", (F.col("window_xmin") + (F.col("window_ymin") / 100).cast("int")).alias("window_index"), "window_xmin", "window_ymin", F.lit(150).alias("window_w"), F.lit(90).alias("window_h"))
    return tiff.band_sums(tiff.read_windows(spark, path, wins)).select("image_path", "window_index", F.col("total").cast("long").alias("n"))


@query("""SELECT concat(image_path, '.tif') AS image_path, CAST(x // 128 * 128 AS INTEGER) AS x, CAST(y // 128 * 128 AS INTEGER) AS y, count(*) AS n FROM pts
  WHERE x < 1000 AND y < 777 AND x // 128 * 128 >= 256 AND y // 128 * 128 < 500 GROUP BY ALL""", PTS_SQL)
def raster_blocks(spark, sf):
    """Sums of pixels over the blocks of a part of each raster; only those blocks are read."""
    found = tiff.blocks(spark, _point_rasters(spark, sf), x=(256, None), y=(None, 500))
    return tiff.band_sums(found).where("total > 0").select("image_path", "x", "y", F.col("total").cast("long").alias("n"))


# Vector files


@query("SELECT ann_id, label, score, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax FROM det", DET_SQL)
def geopackage_round_trip(spark, sf):
    """Boxes written as GeoPackages by tasks, and read again."""
    path = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    vector_sink.write_features(det(spark, sf).select("ann_id", "label", "score", "xmin", "ymin", "xmax", "ymax"), path, epsg=32617)
    back = vector.read_geopackage(spark, path)
    own = lambda c, kind: F.try_element_at("attributes", F.lit(c)).cast(kind).alias(c)
    return back.select(own("ann_id", "long"), own("label", "string"), own("score", "double"), *(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")))


@query('SELECT ann_id, label, ROUND("left" + (x + 0.5) * res, 6) AS x, ROUND(top - (y + 0.5) * res, 6) AS y FROM pts JOIN images USING (image_path)', PTS_SQL, IMAGES_SQL)
def shapefile_round_trip(spark, sf):
    """Points in projected coordinates written as shapefiles by tasks, and read again."""
    path = f"{shared_dir(spark)}/shapes-{uuid.uuid4().hex}"
    vector_sink.write_features(coords.to_geo(pts(spark, sf), images(spark, sf)).select("ann_id", "label", "x", "y"), path, "shapefiles", epsg=32617)
    back = vector.read_shapefile(spark, path)
    own = lambda c, kind: F.try_element_at("attributes", F.lit(c)).cast(kind).alias(c)
    return back.select(own("ann_id", "long"), own("label", "string"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Polygons as geometry: corners cut out of boxes, so that they are concave and SQL can still tell the answer from two boxes each


def _corners(d: DataFrame, *more: str) -> DataFrame:
    """Each box without its quarter of greatest x and y, with the columns `more`."""
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    xs = ("xmin", "xmax", "xmax", mid("xmin", "xmax"), mid("xmin", "xmax"), "xmin")
    ys = ("ymin", "ymin", mid("ymin", "ymax"), mid("ymin", "ymax"), "ymax", "ymax")
    number = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    ring = F.array(*(F.struct(number(x).alias("x"), number(y).alias("y")) for x, y in zip(xs, ys, strict=True)))
    return d.select("ann_id", "image_path", "is_truth", *more, F.array(F.array(ring)).alias("rings"))


_HALVES = """half AS (SELECT ann_id, image_path, is_truth, xmin AS x0, ymin AS y0, xmax AS x1, (ymin + ymax) / 2 AS y1 FROM det
  UNION ALL SELECT ann_id, image_path, is_truth, xmin, (ymin + ymax) / 2, (xmin + xmax) / 2, ymax FROM det),
meet AS (SELECT t.image_path, t.ann_id AS t_ann_id, p.ann_id AS p_ann_id, greatest(t.x0, p.x0) AS x0, greatest(t.y0, p.y0) AS y0, least(t.x1, p.x1) AS x1, least(t.y1, p.y1) AS y1
  FROM half t JOIN half p ON t.image_path = p.image_path AND t.is_truth AND NOT p.is_truth AND t.x0 < p.x1 AND p.x0 < t.x1 AND t.y0 < p.y1 AND p.y0 < t.y1)"""


@query("SELECT image_path, t_ann_id, p_ann_id, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area, CAST(min(x0) AS DOUBLE) AS xmin, CAST(min(y0) AS DOUBLE) AS ymin, CAST(max(x1) AS DOUBLE) AS xmax, CAST(max(y1) AS DOUBLE) AS ymax FROM meet GROUP BY ALL", DET_SQL, _HALVES)
def polygon_intersections(spark, sf):
    """Area and bounds of what concave polygons of truth and predictions have in common."""
    d = written(_corners(det(spark, sf)), "corners")
    found = overlay.intersections(_truth(d), _pred(d))
    return found.select("image_path", "t_ann_id", "p_ann_id", F.round("area", 6).alias("area"), *(F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


_RUNS = """strip AS (SELECT ann_id, image_path, is_truth, y AS row, xmin AS start, CASE WHEN y > (ymin + ymax) / 2 THEN (xmin + xmax) / 2 ELSE xmax END + 1 AS stop
  FROM (SELECT *, unnest(range(ymin, ymax + 1)) AS y FROM det))"""


@query("SELECT ann_id, image_path, is_truth, count(*) AS n_runs, CAST(sum(stop - start) AS BIGINT) AS area, CAST(sum(row * stop) AS BIGINT) AS moment, min(start) AS xmin, min(row) AS ymin, CAST(max(stop) AS INTEGER) AS xmax, CAST(max(row) + 1 AS INTEGER) AS ymax FROM strip GROUP BY ALL", DET_SQL, _RUNS)
def mask_runs(spark, sf):
    """Figures of the runs of concave polygons' masks."""
    m = runs.boxes_of(runs.masks(_corners(det(spark, sf)), images(spark, sf)))
    moment = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["row"].cast("long") * r["stop"])
    return m.select("ann_id", "image_path", "is_truth", F.size("runs").cast("long").alias("n_runs"), runs.area(F.col("runs")).alias("area"), moment.alias("moment"), "xmin", "ymin", "xmax", "ymax")


@query("""SELECT s.image_path, t_ann_id, p_ann_id, inter, round(inter / (a.n + b.n - inter), 9) AS iou FROM (SELECT t.image_path, t.ann_id AS t_ann_id, p.ann_id AS p_ann_id, CAST(sum(least(t.stop, p.stop) - greatest(t.start, p.start)) AS BIGINT) AS inter
  FROM strip t JOIN strip p ON t.image_path = p.image_path AND t.row = p.row AND t.is_truth AND NOT p.is_truth AND t.start < p.stop AND p.start < t.stop GROUP BY ALL) s JOIN size a ON a.ann_id = t_ann_id AND a.image_path = s.image_path AND a.is_truth JOIN size b ON b.ann_id = p_ann_id AND b.image_path = s.image_path AND NOT b.is_truth""", DET_SQL, _RUNS, "size AS (SELECT image_path, ann_id, is_truth, sum(stop - start) AS n FROM strip GROUP BY ALL)")
def mask_overlaps(spark, sf):
    """Pixels in common and IoU of masks of truth and predictions."""
    m = written(runs.band_masks(_corners(det(spark, sf).repartition("image_path", "ann_id")), images(spark, sf), False), "masks")
    found = runs.overlap_pairs(_truth(m), _pred(m))
    return found.withColumns({"inter": F.col("inter").cast("long"), "iou": F.round("iou", 9)})


# Average precision where each box overlaps one other at most, so that SQL can tell the matching

_AP = """hit AS (SELECT label, score, ann_id, unnest([0.5, 0.75]) AS threshold, iou, area FROM (
    SELECT d.label, d.score, d.ann_id, (d.xmax - d.xmin) * (d.ymax - d.ymin) AS area, row_number() OVER (PARTITION BY d.image_path, d.label ORDER BY d.score DESC, d.ann_id) AS k, d.image_path FROM det d WHERE NOT is_truth) q
  LEFT JOIN (SELECT o.image_path, o.p_ann_id, o.iou, t.label AS own FROM one o JOIN det t ON t.ann_id = o.t_ann_id AND t.image_path = o.image_path AND t.is_truth) m ON m.image_path = q.image_path AND m.p_ann_id = q.ann_id AND m.own = q.label WHERE k <= 100),
total AS (SELECT label, count(*) AS n FROM det WHERE is_truth GROUP BY 1),
point AS (SELECT label, threshold, tp, sum(tp) OVER w / n AS r, sum(tp) OVER w / count(*) OVER w AS p FROM (SELECT *, CASE WHEN iou >= threshold THEN 1.0::DOUBLE ELSE 0 END AS tp FROM hit) JOIN total USING (label) WINDOW w AS (PARTITION BY label, threshold ORDER BY score DESC, ann_id ROWS UNBOUNDED PRECEDING)),
level AS (SELECT label, threshold, l, max(p) AS p FROM (SELECT * FROM point WHERE tp = 1) JOIN range(0, 101) g(l) ON r * 100 + 1e-9 >= l GROUP BY ALL)"""


@query("""SELECT label, threshold, round(coalesce(ap, 0), 9) AS ap, round(coalesce(ar, 0), 9) AS ar FROM (SELECT label, unnest([0.5, 0.75])::DOUBLE AS threshold FROM total)
  LEFT JOIN (SELECT label, threshold, sum(p) / 101 AS ap FROM level GROUP BY ALL) USING (label, threshold) LEFT JOIN (SELECT label, threshold, max(r) AS ar FROM point WHERE tp = 1 GROUP BY ALL) USING (label, threshold)""", *_MATCH, _AP)
def average_precision_unique(spark, sf):
    d = det(spark, sf)
    found = precision.average_precision(_truth(d), _pred(d), (0.5, 0.75), pairs=_unique(spark, sf))
    return found.select("label", "threshold", F.round("ap", 9).alias("ap"), F.round("ar", 9).alias("ar"))


@query()
def mask_average_precision(spark, sf):
    """Of masks of concave polygons, by ranges of areas."""
    d = det(spark, sf)
    # masks are made of the truth and of the detections that count; all else that is dealt out is a few numbers a row
    best = precision.ranked(_pred(d).where("label is not null").dropDuplicates(["image_path", "ann_id"])).drop("rank")
    some = d.where("is_truth").repartition("image_path", "ann_id").unionByName(best.withColumn("is_truth", F.lit(False)))
    m = written(runs.band_masks(_corners(some, "label", "score"), images(spark, sf), False).withColumn("area", F.col("size")), "masks")
    return precision.average_precision(_truth(m), _pred(m), areas=precision.AREAS, pairs=runs.overlap_pairs(_truth(m), _pred(m), 512))


@query("SELECT label, ROUND(avg(coalesce(iou, 0)), 9) AS iou FROM det LEFT JOIN (SELECT image_path, t_ann_id AS ann_id, max(iou) AS iou FROM pairs GROUP BY ALL) USING (image_path, ann_id) WHERE is_truth GROUP BY 1", DET_SQL, _PAIR_SQL)
def mean_iou_by_class(spark, sf):
    return evaluate.mean_iou_by_class(_best(spark, sf), _truth(det(spark, sf))).select("label", F.round("iou", 9).alias("iou"))


# Augmentations as one map for each image


def _drawn(step: int, draw: str) -> str:
    return f"('0x' || substr(md5('7:{step}:{draw}:' || image_path), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


_AFFINE = f"""draw AS (SELECT image_path, {_drawn(0, 'p')} < 0.5 AS flip, CASE WHEN {_drawn(1, 'p')} < 0.7 THEN radians(-30 + {_drawn(1, 'angle')} * 60) ELSE 0 END AS t,
  floor({_drawn(2, 'x')} * 501) AS x0, floor({_drawn(2, 'y')} * 701) AS y0 FROM images),
corner AS (SELECT ann_id, image_path, x0, y0, t, CASE WHEN flip THEN 1200 - x ELSE x END - 600 AS x, y - 600 AS y FROM (SELECT ann_id, image_path, unnest([xmin, xmin, xmax, xmax]) AS x, unnest([ymin, ymax, ymin, ymax]) AS y FROM det) JOIN draw USING (image_path)),
turned AS (SELECT ann_id, image_path, cos(t) * x + sin(t) * y + 600 - x0 AS x, cos(t) * y - sin(t) * x + 600 - y0 AS y FROM corner),
cut AS (SELECT ann_id, image_path, least(greatest(min(x), 0), 700) AS xmin, least(greatest(min(y), 0), 500) AS ymin, least(greatest(max(x), 0), 700) AS xmax, least(greatest(max(y), 0), 500) AS ymax FROM turned GROUP BY ALL)"""


@query("SELECT ann_id, image_path, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM cut WHERE xmax - xmin >= 1 AND ymax - ymin >= 1", DET_SQL, IMAGES_SQL, _AFFINE)
def affine_boxes(spark, sf):
    """A random flip, a random turn and a random crop of each image, composed and applied once."""
    chain = [{"RandomCrop": {"size": (500, 700), "p": 1.0}}, "HorizontalFlip", {"Rotate": {"degrees": 30, "p": 0.7}}, {"PadIfNeeded": {"size": (900, 900)}}, "Blur"]
    found = affine.get_transform(chain, seed=7)(det(spark, sf).select("ann_id", "image_path", "xmin", "ymin", "xmax", "ymax").dropDuplicates(["ann_id", "image_path"]), images(spark, sf))
    return found.select("ann_id", "image_path", *(F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


# Training targets


@query("""SELECT i.image_path, CAST(('0x' || substr(md5('shard:' || i.image_path), 1, 8))::BIGINT % 8 AS INTEGER) AS shard, ('0x' || substr(md5('5:2:' || i.image_path), 1, 15))::BIGINT AS place, b.ann_id, CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS label, b.xmin, b.ymin, b.xmax, b.ymax
  FROM images i LEFT JOIN (SELECT ann_id, image_path, label, least(xmin, 700) AS xmin, least(ymin, 500) AS ymin, least(xmax, 700) AS xmax, least(ymax, 500) AS ymax FROM det WHERE is_truth) b ON b.image_path = i.image_path AND b.xmax - b.xmin >= 1 AND b.ymax - b.ymin >= 1""", DET_SQL, IMAGES_SQL)
def target_shards(spark, sf):
    """Targets of truth boxes in images taken as 700 x 500, written in shards and read by three ranks."""
    small = images(spark, sf).select("image_path", F.lit(700).alias("width"), F.lit(500).alias("height"))
    some = _truth(det(spark, sf)).select("ann_id", "image_path", "label", "xmin", "ymin", "xmax", "ymax")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    targets.write_shards(targets.targets(some, small, _LABELS), path, 8, seed=5, epoch=2)
    parts = [targets.read_shards(spark, path, k, 3) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("image_path", "shard", "place", "ann_id", "label", "xmin", "ymin", "xmax", "ymax")
