"""Vector files: what is written reads back equal, by our reader and by others' rules; failed jobs leave nothing."""

import os
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyx.operators import coords
from canopyx.sources import tiff, vector, vector_sink

RINGS = "array<array<array<struct<x: double, y: double>>>>"


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


SQUARE = [[ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))]]
HOLED = [[ring((0, 0), (0, 10), (10, 10), (10, 0)), ring((2, 2), (4, 2), (4, 4), (2, 4))]]
PARTS = [[ring((0, 0), (5, 0), (0, 5))], [ring((20, 20), (30, 20), (30, 30))]]


def polygons(spark):
    rows = [(1, "Tree", 0.5, True, SQUARE), (2, "Bird ü", None, False, HOLED), (3, None, 2.25, None, PARTS), (4, "none", 1.0, True, None), (5, "empty", 1.0, True, [])]
    return spark.createDataFrame(rows, f"n int, label string, score double, ok boolean, rings {RINGS}").repartition(3)


def corners(rings):
    return [[{(v["x"], v["y"]) for v in r} for r in part] for part in rings]


@pytest.mark.parametrize("kind", ["geopackages", "shapefiles"])
def test_polygons_round_trip(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    vector_sink.write_features(polygons(spark), path, kind, epsg=32617)
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    read = vector.read_geopackage if kind == "geopackages" else vector.read_shapefile
    got = {r["attributes"]["n"]: r for r in read(spark, path).collect()}
    assert set(got) == {"1", "2", "3"}
    for n, rings in (("1", SQUARE), ("2", HOLED), ("3", PARTS)):
        assert corners(got[n]["rings"]) == corners(rings)
    assert got["2"]["attributes"]["label"] == "Bird ü" and got["2"]["attributes"].get("score") is None
    assert float(got["3"]["attributes"]["score"]) == 2.25 and (got["3"]["xmin"], got["3"]["ymax"]) == (0.0, 30.0)


@pytest.mark.parametrize("kind", ["geopackages", "shapefiles"])
def test_many_files_and_modes(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    points = spark.range(1000).select("id", (F.col("id") * 0.5).alias("x"), (-F.col("id")).cast("double").alias("y")).repartition(4)
    vector_sink.write_features(points, path, kind, per_file=100)
    ends = [f for f in os.listdir(path) if f.endswith((".gpkg", ".shp"))]
    assert 10 <= len(ends) <= 14
    read = vector.read_geopackage if kind == "geopackages" else vector.read_shapefile
    rows = lambda: sorted((int(r["attributes"]["id"]), r["x"], r["y"]) for r in read(spark, path).collect())
    expected = [(k, k * 0.5, -float(k)) for k in range(1000)]
    assert rows() == expected
    vector_sink.write_features(points.where("id < 3"), path, kind)
    assert rows() == sorted(expected + expected[:3])
    vector_sink.write_features(points.where("id < 5"), path, kind, mode="overwrite")
    assert rows() == expected[:5]
    vector_sink.write_features(points.where("id < 0"), path, kind, mode="overwrite")
    assert rows() == []
    with pytest.raises(Exception, match="geometry"):
        vector_sink.write_features(points.drop("x"), path, kind)


def test_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    vector_sink.write_features(good, path)
    before = sorted(os.listdir(path))
    bad = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") == 3999, F.raise_error(F.lit("no such row")).cast("double")).otherwise(1.0).alias("x"), F.lit(1.0).alias("y"))
    with pytest.raises(Exception, match="no such row"):
        vector_sink.write_features(bad, path, mode="overwrite", per_file=100)
    assert sorted(os.listdir(path)) == before


def test_geopackage_tables():
    """What the format asks for: identifiers, contents with bounds, geometry columns, blobs with their envelope."""
    data = vector_sink.geopackage([(1.0, 2.0), None, (5.0, -2.0)], {"fid": [7, 8, 9], "name": ["a", None, "c"]}, "point", "trees", 32733)[".gpkg"]
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    assert db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47 and db.execute("PRAGMA integrity_check").fetchone()[0] == "ok"
    assert db.execute("SELECT table_name, data_type, min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents").fetchall() == [("trees", "features", 1.0, -2.0, 5.0, 2.0, 32733)]
    assert db.execute("SELECT column_name, geometry_type_name, srs_id FROM gpkg_geometry_columns").fetchall() == [("geom", "POINT", 32733)]
    assert 'ZONE' in db.execute("SELECT upper(definition) FROM gpkg_spatial_ref_sys WHERE srs_id = 32733").fetchone()[0]
    rows = db.execute("SELECT fid, geom, fid_, name FROM trees ORDER BY fid").fetchall()
    assert [(r[0], r[2], r[3]) for r in rows] == [(1, 7, "a"), (2, 8, None), (3, 9, "c")] and rows[1][1] is None
    assert rows[0][1][:2] == b"GP" and struct.unpack_from("<i4d", rows[0][1], 4) == (32733, 1.0, 1.0, 2.0, 2.0) and struct.unpack_from("<BI2d", rows[0][1], 40) == (1, 1, 1.0, 2.0)


def test_simple_geometries_are_made_and_read_by_the_batch(monkeypatch):
    """Boxes and points in any order, of negative width, beside rows without geometry and forms that only the plain path reads."""
    boxes = [(0.0, 1.0, 4.0, 3.0), None, (5.0, 5.0, 2.0, 1.0)]
    names = {"n": [1, 2, 3], "text": ["a", None, "ü"], "raw": [True, None, 2.5]}
    data = vector_sink.geopackage(boxes, names, "box", "t", 32617)[".gpkg"]
    rings = vector_sink.geopackage([None if b is None else vector_sink.parts_of(b) for b in boxes], names, "rings", "t", 32617)[".gpkg"]
    plain = [r for b in vector.package(rings, "s") for r in b.to_pylist()]
    assert [r["fid"] for r in plain] == [1, 3] and plain[1]["xmin"] == 2.0 and plain[0]["attributes"] == [("fid", "1"), ("n", "1"), ("text", "a"), ("raw", "1")]
    for kind, shapes in (("box", boxes), ("point", [(1.0, 2.0), None, (-5.0, 2.0), (float("nan"), float("nan"))])):
        own = {"n": list(range(len(shapes)))}
        made = vector_sink.geopackage(shapes, own, kind, "t", 32617)[".gpkg"]
        monkeypatch.setattr(vector, "from_wkb", lambda *a: None)
        fast = [r for b in vector.package(made, "s") for r in b.to_pylist()]
        monkeypatch.undo()
        monkeypatch.setattr(vector, "_simple", lambda blobs: iter(()))
        slow = [r for b in vector.package(made, "s") for r in b.to_pylist()]
        monkeypatch.undo()
        assert fast == slow and [r["fid"] for r in fast] == [1, 3]
    got = [r for b in vector.package(data, "s") for r in b.to_pylist()]
    assert got == plain


def test_shapefile_parts():
    """Lengths, bounds, the index, ring directions and field names."""
    outer = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    hole = np.array([(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)], float)
    names = {"a_long_name_1": [1, None], "a_long_name_2": [None, 2.5], "text": ["x" * 300, None]}
    files = vector_sink.shapefile([[[outer, hole]], None], names, "rings", "t", 32617)
    shp, shx, dbf = files[".shp"], files[".shx"], files[".dbf"]
    assert struct.unpack_from(">i", shp)[0] == 9994 and struct.unpack_from(">i", shp, 24)[0] * 2 == len(shp) and struct.unpack_from(">i", shx, 24)[0] * 2 == len(shx)
    assert struct.unpack_from("<4d", shp, 36) == (0.0, 0.0, 4.0, 4.0)
    for k in range(2):
        at, words = struct.unpack_from(">2i", shx, 100 + 8 * k)
        assert struct.unpack_from(">2i", shp, at * 2) == (k + 1, words)
    (feature,) = vector.shapes(shp, "s")
    rings = [np.array([(v["x"], v["y"]) for v in r]) for r in feature[-1][0]]
    turn = lambda r: (r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()
    assert turn(rings[0]) < 0 < turn(rings[1])
    first, second = vector.table(dbf)
    assert list(first) == ["a_long_nam", "a_long_na1", "text"] and first["a_long_nam"] == "1" and second["a_long_na1"] == "2.5" and first["text"] == "x" * 254
    assert b"central_meridian\",-81" in files[".prj"] and vector_sink.utm(4326) == "" and "zone 33S" in vector_sink.utm(32733)


def test_pixels_and_systems(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "one.tif").write_bytes(tiff.encode(np.zeros((40, 60, 3), "u1"), 16, geo=(1000.0, 5000.0, 0.5), epsg=32617))
    images = tiff.layouts(spark, str(tmp_path / "img"))
    boxes = spark.createDataFrame([(0, "one.tif", "Tree", 2.0, 3.0, 12.0, 9.0)], "ann_id long, image_path string, label string, xmin double, ymin double, xmax double, ymax double")
    for kind, end in (("geopackages", "gpkg"), ("shapefiles", "shp")):
        for epsg, warned in ((32617, 0), (32618, 1)):
            out = tmp_path / f"{end}{epsg}"
            vector_sink.write_features(coords.to_geo(boxes, images).coalesce(1), str(out), kind, epsg=epsg)
            for f in os.listdir(out):
                os.rename(out / f, out / f"one.{f.rpartition('.')[2]}")
            import warnings

            with warnings.catch_warnings(record=True) as seen:
                warnings.simplefilter("always")
                got = vector.read_annotations(spark, f"{out}/one.{end}", images).collect()
            assert sum("EPSG" in str(w.message) for w in seen) == warned
            # pixel centres: half a pixel more than the corner that was read
            assert [(r["image_path"], r["label"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in got] == [("one.tif", "Tree", 2.5, 3.5, 12.5, 9.5)]
            assert {(v["x"], v["y"]) for v in got[0]["rings"][0][0]} == {(2.5, 3.5), (2.5, 9.5), (12.5, 9.5), (12.5, 3.5)}
    plain = images.withColumns({c: F.lit(None).cast("double") for c in ("left", "top", "res")})
    assert vector.read_annotations(spark, f"{out}/one.shp", plain).first()["xmin"] == 1001.25
