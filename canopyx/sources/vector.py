"""Vector files, Shapefile and GeoPackage: bytes come through Spark's reader, so any path that Spark can read will do.

A row for each feature: source (the file's name without its ending), fid, geom_type, x and y (points), the box, rings
(polygons: parts, rings, vertices) and attributes as text. A file is read by one task. Heights and measures are dropped,
features without a geometry too. Other kinds of geometry are an error.
"""

from __future__ import annotations

import json
import sqlite3
import struct
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyx.operators.coords import reject_geographic, to_pixels
from canopyx.types import BOX

_SHAPE = "source string, fid long, geom_type string, x double, y double, xmin double, ymin double, xmax double, ymax double, rings array<array<array<struct<x: double, y: double>>>>"
_NAMES = [c.split(":")[0].split()[0] for c in _SHAPE.split(", ")[:10]]

#: Fixed values of the formats: shape types, and well-known binary types.
SHP_NULL, SHP_POINTS, SHP_POLYGONS = 0, (1, 11, 21), (5, 15, 25)
WKB_POINT, WKB_POLYGON, WKB_MULTIPOLYGON = 1, 3, 6
ENVELOPE_BYTES = (0, 32, 48, 48, 64)


def _feature(source: str, fid: int, parts: list[list[np.ndarray]] | None, point: tuple[float, float] | None = None) -> tuple:
    if point is not None:
        return source, fid, "point", *point, None, None, None, None, None
    xy = np.concatenate([ring for part in parts for ring in part])
    rings = [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]
    return source, fid, "polygon", None, None, *map(float, (*xy.min(axis=0), *xy.max(axis=0))), rings


def _turn(ring: np.ndarray) -> float:
    """Positive for counter-clockwise rings."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def shapes(data: bytes, source: str) -> Iterator[tuple]:
    """Features of a .shp file. A clockwise ring starts a part, others are its holes."""
    at = 100
    while at + 12 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        (kind,) = struct.unpack_from("<i", data, at + 8)
        body, at = at + 12, at + 8 + 2 * words
        if kind in SHP_POINTS:
            yield _feature(source, number, None, struct.unpack_from("<2d", data, body))
        elif kind in SHP_POLYGONS:
            n_parts, n_points = struct.unpack_from("<2i", data, body + 32)
            starts = [*struct.unpack_from(f"<{n_parts}i", data, body + 40), n_points]
            xy = np.frombuffer(data, "<f8", 2 * n_points, body + 40 + 4 * n_parts).reshape(-1, 2)
            parts: list[list[np.ndarray]] = []
            for s, e in zip(starts, starts[1:], strict=False):
                if not parts or _turn(xy[s:e]) < 0:
                    parts.append([])
                parts[-1].append(xy[s:e])
            if n_points:
                yield _feature(source, number, parts)
        elif kind != SHP_NULL:
            raise ValueError(f"{source}: shape type {kind} is not supported")


def table(data: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """Records of a .dbf file as text; empty fields are null. Deleted records keep their place."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields, start = [], 1
    for at in range(32, head - 1, 32):
        if data[at] == 0x0D:
            break
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), start, start + data[at + 16]))
        start += data[at + 16]
    for k in range(count):
        row = data[head + k * size : head + (k + 1) * size]
        yield {name: row[s:e].strip(b" \0").decode(encoding, "replace") or None for name, s, e in fields}


def _files(spark: SparkSession, path: str, end: str) -> DataFrame:
    """source and content of the files with an ending: path is a folder, or one file, whose sidecars lie beside it."""
    folder, _, name = path.rpartition("/")
    one = name.endswith((".shp", ".gpkg"))
    mask = (name.rpartition(".")[0] if one else "*") + end
    found = spark.read.format("binaryFile").option("pathGlobFilter", mask).load((folder or ".") if one else path)
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("source"), "content")


def read_shapefile(spark: SparkSession, folder: str) -> DataFrame:
    """A shapefile, or all of a folder; geometry and attributes join by file and record number. Geographic coordinates are an error."""

    def geometry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, data in zip(frame["source"], frame["content"], strict=True):
                yield pd.DataFrame(list(shapes(data, source)), columns=_NAMES)

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, data in zip(frame["source"], frame["content"], strict=True):
                rows = [(source, k, json.dumps(r)) for k, r in enumerate(table(data), 1)]
                yield pd.DataFrame(rows, columns=["source", "fid", "attributes"])

    for row in _files(spark, folder, ".prj").where(F.decode("content", "utf-8").rlike(r"^\s*GEOGCS")).limit(1).collect():
        raise ValueError(f"{row['source']}: geographic coordinates: project them first")
    shp = _files(spark, folder, ".shp").mapInPandas(geometry, _SHAPE)
    dbf = _files(spark, folder, ".dbf").mapInPandas(records, "source string, fid long, attributes string")
    return shp.join(dbf, ["source", "fid"], "left").withColumn("attributes", F.from_json("attributes", "map<string, string>"))


def from_wkb(data: bytes, source: str, fid: int) -> tuple | None:
    """A feature from well-known binary, in either byte order and with or without heights; None if it is empty."""

    def read(at: int) -> tuple[int, object, int]:
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(f"{order}I", data, at + 1)
        kind, at = code % 1000, at + 5
        width = 2 + (0, 1, 1, 2)[code // 1000]
        if kind == WKB_POINT:
            return kind, struct.unpack_from(f"{order}2d", data, at), at + 8 * width
        if kind not in (WKB_POLYGON, WKB_MULTIPOLYGON):
            raise ValueError(f"{source}: geometry type {kind} is not supported")
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at, parts = at + 4, []
        for _ in range(n):
            if kind == WKB_MULTIPOLYGON:
                _, inner, at = read(at)
                parts += inner
            else:
                (m,) = struct.unpack_from(f"{order}I", data, at)
                parts.append(np.frombuffer(data, f"{order}f8", m * width, at + 4).reshape(m, width)[:, :2])
                at += 4 + 8 * m * width
        return kind, parts if kind == WKB_MULTIPOLYGON else [parts], at

    kind, found, _ = read(0)
    if kind == WKB_POINT:
        return None if np.isnan(found).any() else _feature(source, fid, None, found)
    parts = [part for part in found if sum(map(len, part))]
    return _feature(source, fid, parts) if parts else None


#: Rows of a table that are read at once.
AT_ONCE = 20_000
_RINGS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
_FEATURES = pa.schema([("source", pa.string()), ("fid", pa.int64()), ("geom_type", pa.string()), *((c, pa.float64()) for c in ("x", "y", *BOX)), ("rings", _RINGS), ("attributes", pa.map_(pa.string(), pa.string()))])


def _simple(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Of blobs, places and coordinates (rows, vertices, 2) of points, and of polygons of one ring with a number of vertices:
    those in little-endian order without heights, in groups of equal form. Others are left out."""
    length = np.fromiter(map(len, blobs), np.int64, len(blobs))
    for size in np.unique(length).tolist():
        places = np.flatnonzero(length == size)
        rows = np.frombuffer(b"".join([blobs[i] for i in places]), np.uint8).reshape(-1, size)
        for flags in np.unique(rows[:, 3]).tolist():
            head = 8 + ENVELOPE_BYTES[flags >> 1 & 7] if flags >> 1 & 7 < len(ENVELOPE_BYTES) else size
            if flags & 0x10 or size < head + 21:
                continue
            for kind, skip in ((WKB_POINT, 5), (WKB_POLYGON, 13)):
                n, rest = divmod(size - head - skip, 16)
                if rest or n < 1 or kind == WKB_POINT and n > 1:
                    continue
                want = np.frombuffer(struct.pack("<BI", 1, kind) + (struct.pack("<II", 1, n) if kind == WKB_POLYGON else b""), np.uint8)
                same = np.flatnonzero((rows[:, 3] == flags) & (rows[:, head : head + skip] == want).all(axis=1))
                if not len(same):
                    continue
                xy = np.ascontiguousarray(rows[same, head + skip :]).view("<f8").reshape(len(same), n, 2)
                # an empty point is one of no numbers
                full = ~np.isnan(xy).any(axis=(1, 2)) if kind == WKB_POINT else np.full(len(same), True)
                yield places[same[full]], xy[full], kind == WKB_POINT


def _nested(xy: np.ndarray) -> pa.Array:
    """Polygons of one ring each."""
    count, n = xy.shape[:2]
    flat = np.ascontiguousarray(xy.reshape(-1, 2))
    ends = pa.array(np.arange(0, (count + 1) * n, n, dtype=np.int32)[: count + 1])
    ones = pa.array(np.arange(count + 1, dtype=np.int32))
    rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(ones, pa.ListArray.from_arrays(ones, pa.ListArray.from_arrays(ends, rows)))


def package(data: bytes, source: str) -> Iterator[pa.RecordBatch]:
    """Features of all feature tables of a GeoPackage, with their attributes; simple geometries are read by the batch."""
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    for name, column, srid in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
        reject_geographic(srid)
        rows = db.execute(f"SELECT rowid AS _fid, * FROM {quoted(name)} ORDER BY rowid")
        names = [c[0] for c in rows.description][1:]
        at, others = names.index(column) + 1, [k for k, c in enumerate(names, 1) if c != column]
        while some := rows.fetchmany(AT_ONCE):
            some = [r for r in some if r[at] is not None and not r[at][3] & 0x10]  # others have no geometry, or an empty one
            blobs = [r[at] for r in some]
            left = np.full(len(some), True)
            for places, xy, point in _simple(blobs):
                left[places] = False
                own, none = [some[i] for i in places], pa.nulls(len(places), pa.float64())
                box = [none] * 4 if point else [pa.array(np.ascontiguousarray(c)) for c in (*xy.min(axis=1).T, *xy.max(axis=1).T)]
                x, y = (pa.array(np.ascontiguousarray(xy[:, 0, k])) if point else none for k in (0, 1))
                yield _features(source, own, ["point" if point else "polygon"] * len(own), [x, y, *box], pa.nulls(len(own), _RINGS) if point else _nested(xy), [names[k - 1] for k in others], others)
            own, found = [], []
            for i in np.flatnonzero(left).tolist():
                shape = from_wkb(blobs[i][8 + ENVELOPE_BYTES[blobs[i][3] >> 1 & 7] :], source, some[i][0])
                if shape:
                    own.append(some[i])
                    found.append(shape)
            if own:
                columns = list(zip(*found, strict=True))
                yield _features(source, own, list(columns[2]), [pa.array(c, pa.float64()) for c in columns[3:9]], pa.array(columns[9], _RINGS), [names[k - 1] for k in others], others)
    db.close()


def _features(source: str, rows: list[tuple], kinds: list[str], numbers: list[pa.Array], rings: pa.Array, names: list[str], places: list[int]) -> pa.RecordBatch:
    """A batch of features; attributes are text, without those that are bytes."""
    keys, items, ends = [], [], [0]
    for row in rows:
        values = [row[k] for k in places]
        if any(isinstance(v, bytes) for v in values):
            keys += [c for c, v in zip(names, values, strict=True) if not isinstance(v, bytes)]
            values = [v for v in values if not isinstance(v, bytes)]
        else:
            keys += names
        items += [v if v is None or isinstance(v, str) else str(v) for v in values]
        ends.append(len(items))
    attributes = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(items, pa.string()))
    fields = [pa.array([source] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array(kinds, pa.string()), *numbers, rings.cast(_RINGS), attributes]
    return pa.RecordBatch.from_arrays(fields, schema=_FEATURES)


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """A GeoPackage, or all of a folder. Geographic coordinates are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from package(data.as_py(), source.as_py())

    return _files(spark, path, ".gpkg").mapInArrow(run, f"{_SHAPE}, attributes map<string, string>")


def annotations(features: DataFrame, label: str = "label", image_path: str | None = None) -> DataFrame:
    """Features as annotations: ann_id, label from an attribute, and image_path (by default source with .tif). One kind of geometry only."""
    kinds = [r[0] for r in features.select("geom_type").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError("more than one kind of geometry")
    own = F.lit(image_path) if image_path else F.concat("source", F.lit(".tif"))
    return features.withColumns({"ann_id": F.col("fid"), "image_path": own, "label": F.try_element_at("attributes", F.lit(label))}).drop("fid", "source", "attributes")


def crs(spark: SparkSession, path: str) -> DataFrame:
    """source and epsg of the .gpkg or .shp files of a path; null where none is known."""

    def packages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, data in zip(frame["source"], frame["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(data)
                rows += [(source, None if srid < 1 else srid) for (srid,) in db.execute("SELECT DISTINCT srs_id FROM gpkg_geometry_columns")]
                db.close()
            yield pd.DataFrame(rows, columns=["source", "epsg"]).astype({"epsg": "Int64"})

    if path.endswith(".shp"):
        # the last authority is that of the whole
        code = F.regexp_extract(F.decode("content", "utf-8"), r'(?s)AUTHORITY\["EPSG",\s*"?(\d+)"?\]\s*\]\s*$', 1)
        return _files(spark, path, ".prj").select("source", F.when(code != "", code.cast("int")).alias("epsg"))
    return _files(spark, path, ".gpkg").mapInPandas(packages, "source string, epsg int")


def read_annotations(spark: SparkSession, path: str, images: DataFrame | None = None) -> DataFrame:
    """annotations() of a .gpkg or .shp file; polygons keep their rings beside the box, points have x and y alone.

    With images (image_path, left, top, res, epsg, as of tiff.layouts()) coordinates become pixels of the image that bears the
    file's name; another coordinate system than the image's is a warning. Images without a georeference keep them as they are.
    """
    rows = annotations((read_geopackage if path.endswith(".gpkg") else read_shapefile)(spark, path))
    first = rows.select("geom_type").first()
    rows = rows.drop(*BOX, "rings") if first and first[0] == "point" else rows.drop("x", "y")
    if images is None:
        return rows
    known = images.where("left is not null")
    named = crs(spark, path).where("epsg is not null").withColumn("image_path", F.concat("source", F.lit(".tif")))
    for r in named.join(known.select("image_path", F.col("epsg").alias("own")), "image_path").where("epsg <> own").limit(5).collect():
        warnings.warn(f"{r['source']}: coordinates in EPSG:{r['epsg']}, the image's in EPSG:{r['own']}", UserWarning, stacklevel=2)
    same = rows.join(known.select("image_path").distinct(), "image_path", "left_anti")
    return to_pixels(rows, known).select(rows.columns).unionByName(same)
