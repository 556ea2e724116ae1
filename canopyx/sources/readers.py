"""Annotation sources as one relation."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyx.functions import boxes
from canopyx.operators import overlay, polygons
from canopyx.sources import vector
from canopyx.types import geometry_kind


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """With a header; give a schema to skip the extra scan that guesses types."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


_COCO = (
    "images array<struct<id: long, file_name: string, width: int, height: int>>, categories array<struct<id: long, name: string>>,"
    "annotations array<struct<id: long, image_id: long, category_id: long, segmentation: string, bbox: array<double>, area: double, iscrowd: int>>"
)


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """A row for each annotation with a valid part: box (the file's own, else the parts' bounds), rings (its valid parts
    united) and label. Run-length segmentations are left out."""
    doc = spark.read.schema(_COCO).option("multiLine", True).json(path)
    ann = doc.select(F.explode("annotations").alias("a")).select("a.*").where(F.substring(F.trim("segmentation"), 1, 1) == "[")
    flat = F.from_json("segmentation", "array<array<double>>")
    odd = F.exists(flat, lambda p: F.size(p) % 2 == 1)
    vertex = lambda p: F.transform(F.sequence(F.lit(0), (F.size(p) / 2).cast("int") - 1), lambda i: F.struct(p[i * 2].alias("x"), p[i * 2 + 1].alias("y")))
    rings = F.transform(F.filter(flat, lambda p: F.size(p) >= 6), lambda p: F.array(vertex(p)))
    ann = ann.withColumn("rings", F.when(odd, F.raise_error(F.lit("a coordinate list has an odd length"))).otherwise(rings)).where(F.size("rings") > 0)
    ann = overlay.united(ann.select("id", "image_id", "category_id", "iscrowd", "area", "bbox", "rings"))
    low = lambda c, i: F.coalesce(F.get("bbox", F.lit(i)), F.col(c)).alias(c)
    high = lambda c, i: F.coalesce(F.get("bbox", F.lit(i)) + F.get("bbox", F.lit(i + 2)), F.col(c)).alias(c)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), boxes.basename(F.col("i.file_name")).alias("image_path"))
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    out = ann.join(images, "image_id", "left").join(names, "category_id", "left")
    return out.select(F.col("id").alias("ann_id"), "image_path", "label", low("xmin", 0), low("ymin", 1), high("xmax", 0), high("ymax", 1), "rings", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"), F.coalesce("area", F.lit(0.0)).alias("area"))


_VOC = "filename string, object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"


def read_pascal_voc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each object; coordinates round to whole numbers, halves to even."""
    doc = spark.read.format("xml").option("rowTag", "annotation").schema(_VOC).load(path)
    o = doc.select(boxes.basename(F.col("filename")).alias("image_path"), F.explode("object").alias("o"))
    return o.select("image_path", *(boxes.round_half_even(F.col(f"o.bndbox.{c}")).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), F.col("o.name").alias("label"))


def with_shapes(df: DataFrame) -> DataFrame:
    """Well-known text of points or polygons (column geometry, else polygon) as x and y, or as rings; the first row says which.
    Text of another kind raises. Other frames stay as they are."""
    kinds = dict(df.dtypes)
    name = next((c for c in ("geometry", "polygon") if kinds.get(c) == "string"), None)
    if name is None or "rings" in kinds:
        return df
    text = F.upper(F.trim(name))
    first = df.where(F.col(name).isNotNull()).select(text.alias("t")).first()
    point = first is not None and first["t"].startswith("POINT")
    fits = text.startswith("POINT") if point else text.rlike(r"^(MULTI)?POLYGON")
    known = F.when(fits, F.col(name)).when(F.col(name).isNotNull(), F.raise_error(F.concat(F.lit("a geometry of another kind: "), F.substring(name, 1, 40))))
    if point:
        number = lambda k: F.regexp_extract(known, r"\(\s*(\S+)\s+([^\s)]+)", k).cast("double")
        return df.withColumns({"x": number(1), "y": number(2)})
    return df.withColumn("rings", polygons.parse_wkt(F.upper(known)))


def read_annotations(spark: SparkSession, source: str | DataFrame, root_dir: str | None = None, image_path: str | None = None, label: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """A frame or a .csv, .json, .xml, .gpkg or .shp path to annotations with image_path, label and root_dir. Given arguments
    override. Shapes in text become rings, or x and y. A frame without rows raises. images (as of tiff.layouts()) turn projected
    coordinates of vector files into pixels."""
    if isinstance(source, DataFrame):
        df = source
        if df.isEmpty():
            raise ValueError("no annotations")
    else:
        by_end = {".csv": read_csv, ".json": read_coco, ".xml": read_pascal_voc, ".gpkg": vector.read_annotations, ".shp": vector.read_annotations}
        end = os.path.splitext(source)[1].lower()
        if end not in by_end:
            raise ValueError(f"unknown kind of file: {end}")
        df = by_end[end](spark, source) if end not in (".gpkg", ".shp") else vector.read_annotations(spark, source, images)
    if image_path is not None and root_dir is None and isinstance(source, DataFrame):
        raise ValueError("image_path needs root_dir")
    df = with_shapes(df)
    geometry_kind(df.columns)
    for name, given in (("image_path", image_path), ("label", label)):
        if given is not None:
            df = df.withColumn(name, F.lit(given))
        elif name not in df.columns:
            raise ValueError(f"no {name}")
    if root_dir is None and not isinstance(source, DataFrame):
        root_dir = os.path.dirname(source)
    if root_dir is not None:
        df = df.withColumn("root_dir", F.lit(root_dir))
    elif "root_dir" not in df.columns:
        raise ValueError("no root_dir")
    return df


def predictions(raw: DataFrame, kind: str = "box") -> DataFrame:
    """Raw detections (image_path, boxes or points, labels, scores as arrays) to rows."""
    if kind == "polygon":
        raise ValueError("polygons are not supported here")
    many, names = ("boxes", ("xmin", "ymin", "xmax", "ymax")) if kind == "box" else ("points", ("x", "y"))
    rows = raw.select("image_path", F.explode(F.arrays_zip(many, "labels", "scores")).alias("d"))
    return rows.select("image_path", *(F.col(f"d.{many}")[i].alias(c) for i, c in enumerate(names)), F.col("d.labels").alias("label"), F.col("d.scores").alias("score"))


def image_folder(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, class name (the folder) and its number over all roots, in the names' order."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(r).select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label")) for r in roots]
    files = reduce(DataFrame.unionByName, parts)
    names = [r["label"] for r in files.select("label").distinct().orderBy("label").collect()]
    table = F.create_map(*(F.lit(x) for kv in {n: i for i, n in enumerate(names)}.items() for x in kv))
    return files.withColumn("label_id", table[F.col("label")])


def tiles_of(bounds: tuple[float, float, float, float], zoom: int, spark: SparkSession) -> DataFrame:
    """x, y of the map tiles over (west, south, east, north)."""
    west, south, east, north = (F.lit(float(v)) for v in bounds)
    x0, y0 = boxes.tile_numbers(north, west, zoom)
    x1, y1 = boxes.tile_numbers(south, east, zoom)
    whole = lambda c: F.floor(c).cast("int")
    return spark.range(1).select(F.explode(F.sequence(whole(x0), whole(x1))).alias("x"), F.sequence(whole(y0), whole(y1)).alias("ys")).select("x", F.explode("ys").alias("y"))


def web_kind(url: str) -> str:
    """Which kind of map server an address is."""
    if re.search(r"/(Image|Map)Server", url):
        return "arcgis"
    if all(k in url for k in ("{z}", "{x}", "{y}")):
        return "tiles"
    raise ValueError("not a known kind of map server")


def label_ordinal(ann: DataFrame) -> DataFrame:
    """label, ordinal of its first appearance by ann_id."""
    from pyspark.sql import Window

    first = ann.groupBy("label").agg(F.min("ann_id").alias("_first"))
    return first.select("label", (F.row_number().over(Window.orderBy("_first")) - 1).alias("ordinal"))


def encode_label(label: Column, names: dict[str, int]) -> Column:
    """Name to number; an unlisted name is an error."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.when(label.isNull() | F.map_contains_key(table, label), F.try_element_at(table, label)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)))
