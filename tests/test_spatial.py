"""Worked examples with known results."""

import itertools
import json
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from canopyx import config
from canopyx.functions import boxes
from canopyx.operators import coords, density, evaluate, matching, polygons, precision, runs, sampling, suppress, tiling, validate
from canopyx.plans import registry
from canopyx.scorer import predict_tile
from canopyx.sources import rasters, readers, vector, writers
from canopyx.streaming.metrics import running_counts

BOX = "ann_id long, image_path string, xmin double, ymin double, xmax double, ymax double, label string, score double"
POINT = "ann_id long, image_path string, x double, y double, label string, score double"


def test_class_metrics(spark):
    m = spark.createDataFrame([("1", "1"), ("1", "2"), ("2", "1"), ("2", None)], "true_label string, predicted_label string")
    got = {r["label"]: (r["recall"], r["precision"], r["size"]) for r in evaluate.class_metrics(m).collect()}
    assert got == {"1": (0.5, 0.5, 2), "2": (0.0, 0.0, 1)}


def test_point_evaluation(spark):
    pred = spark.createDataFrame([(0, "a", 1.0, 25.0, "Tree", 0.9)], POINT)
    truth = spark.createDataFrame([(0, "a", 1.5, 30.0, "Tree", None), (1, "a", 20.0, 300.0, "Tree", None)], POINT)
    got = evaluate.evaluate(pred, truth, "point")["macro"].first()
    assert (got["recall"], got["precision"]) == (0.5, 1.0)
    with pytest.raises(ValueError):
        matching.match_predictions(pred, truth, "line")


def test_images_without_predictions(spark):
    truth = spark.createDataFrame([(0, "a", 0.0, 0.0, 10.0, 10.0, "T", None), (1, "a", 20.0, 20.0, 30.0, 30.0, "T", None)], BOX)
    pred = spark.createDataFrame([(0, "b", 0.0, 0.0, 10.0, 10.0, "T", 0.5)], BOX)
    got = evaluate.evaluate(pred, truth)
    rows = got["results"].collect()
    assert len(rows) == 2 and all(r["prediction_id"] is None and not r["match"] for r in rows)
    assert got["macro"].first()["recall"] == 0.0 and got["macro"].first()["precision"] is None


def test_points_in_boxes(spark):
    points = spark.createDataFrame([(0, "a", 5.0, 30.0, "T", None), (1, "a", 20.0, 300.0, "T", None)], POINT)
    truth = spark.createDataFrame([(0, "a", 1.0, 1.0, 100.0, 50.0, "T", None), (1, "a", 150.0, 75.0, 200.0, 100.0, "T", None)], BOX)
    got = {r["ann_id"]: r["t_ann_id"] for r in matching.points_in_boxes(points, truth).collect()}
    assert got == {0: 0, 1: None}


def test_translate(spark):
    b = spark.createDataFrame([(1.9, 2.0, 3.0, 4.0, 10, 20), (5.0, 6.0, 9.0, 10.0, 100, 200)], "xmin double, ymin double, xmax double, ymax double, window_xmin int, window_ymin int")
    assert [tuple(r) for r in suppress.translate(b).collect()] == [(11, 22, 13, 24), (105, 206, 109, 210)]
    p = spark.createDataFrame([(5, 6, 100, 300), (10, 12, 200, 400)], "x int, y int, window_xmin int, window_ymin int")
    assert [tuple(r) for r in suppress.translate(p).collect()] == [(105, 306), (210, 412)]
    with pytest.raises(ValueError):
        suppress.mosaic(b)


def test_squares(spark):
    d = spark.createDataFrame([(0.0, 0.0, 20.0, 30.0), (10.0, 10.0, 180.0, 180.0), (40.0, 30.0, 60.0, 70.0)], "xmin double, ymin double, xmax double, ymax double")
    got = [tuple(r) for r in d.select(*boxes.square(boxes.box(), F.lit(100.0), F.lit(100.0))).collect()]
    assert got == [(0, 0, 30, 30), (0, 0, 100, 100), (30, 30, 70, 70)]


def test_counters(spark):
    per = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, None)], "image_path string, recall double, precision double")
    empty = spark.createDataFrame([("c",), ("d",)], "image_path string")
    pred = spark.createDataFrame([("a",), ("d",)], "image_path string")
    got = evaluate.from_counters(evaluate.counters(per, empty, pred)).first()
    assert (got["box_recall"], got["box_precision"], got["empty_frame_accuracy"]) == (0.5, 0.5, 0.5)
    got = evaluate.from_counters(evaluate.counters(per.where("false"), empty, pred.where("false"))).first()
    assert (got["box_recall"], got["empty_frame_accuracy"]) == (None, 1.0)


def test_coco(spark, tmp_path):
    square = [0, 0, 10, 0, 10, 10, 0, 10]
    doc = {"images": [{"id": 1, "file_name": "x/a.png", "width": 9, "height": 9}], "categories": [{"id": 1, "name": "Tree"}, {"id": 2, "name": "Bird"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "segmentation": [square]}, {"id": 2, "image_id": 1, "category_id": 2, "segmentation": [square, [1, 2]]}, {"id": 3, "image_id": 1, "category_id": 2, "segmentation": {"counts": "x"}}, {"id": 4, "image_id": 9, "category_id": 2, "segmentation": [square]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    got = readers.read_annotations(spark, str(tmp_path / "c.json")).orderBy("ann_id").collect()
    assert [(r["image_path"], r["label"], r["xmin"], r["ymin"], r["xmax"], r["ymax"], r["iscrowd"]) for r in got] == [("a.png", "Tree", 0, 0, 10, 10, 0), ("a.png", "Bird", 0, 0, 10, 10, 0), (None, "Bird", 0, 0, 10, 10, 0)]


def test_voc_and_csv(spark, tmp_path):
    (tmp_path / "v.xml").write_text("<annotation><filename>d/p.tif</filename><object><name>Tree</name><bndbox><xmin>1.5</xmin><ymin>2.5</ymin><xmax>7</xmax><ymax>8</ymax></bndbox></object></annotation>")
    r = readers.read_annotations(spark, str(tmp_path / "v.xml")).first()
    assert (r["image_path"], r["xmin"], r["ymin"], r["xmax"], r["label"], r["root_dir"]) == ("p.tif", 2, 2, 7, "Tree", str(tmp_path))
    d = spark.createDataFrame([(0, "a.png", 0.0, 0.0, 1.0, 1.0, "T", 0.5)], BOX)
    writers.write_csv(d, str(tmp_path / "o.csv"))
    assert readers.read_annotations(spark, str(tmp_path / "o.csv"), label="Own").first()["label"] == "Own"
    writers.write_by_image(d, str(tmp_path / "by"))
    assert writers.with_wkt(d).first()["geometry"].startswith("POLYGON ((0.0 0.0, ")
    for bad in ("x.txt", d.drop("xmin")):
        with pytest.raises(ValueError):
            readers.read_annotations(spark, bad, root_dir="r")


def _shapefile(folder, name, shapes, labels):
    """A small .shp and .dbf: shapes are points (x, y) or lists of rings."""
    import struct

    body = b""
    for n, s in enumerate(shapes, 1):
        if s is None:
            rec = struct.pack("<i", 0)
        elif isinstance(s, tuple):
            rec = struct.pack("<i2d", 1, *s)
        else:
            flat = [v for ring in s for p in ring for v in p]
            starts = np.cumsum([0, *map(len, s)])[:-1].tolist()
            rec = struct.pack(f"<i4d2i{len(s)}i{len(flat)}d", 5, 0, 0, 0, 0, len(s), len(flat) // 2, *starts, *flat)
        body += struct.pack(">ii", n, len(rec) // 2) + rec
    (folder / f"{name}.shp").write_bytes(bytes(100) + body)
    field = b"label".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4xIHH20x", len(labels), 65, 9) + field + b"\r" + b"".join(b" " + v.encode().ljust(8) for v in labels))


HOLED = [[(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)], [(20, 0), (20, 5), (25, 5), (20, 0)]]


def test_shapefiles(spark, tmp_path):
    _shapefile(tmp_path, "one", [HOLED, None, HOLED[:1]], ["Tree", "gone", ""])
    got = {r["fid"]: r for r in vector.read_shapefile(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 3] and [len(p) for p in got[1]["rings"]] == [2, 1]
    assert [got[1][c] for c in ("xmin", "ymin", "xmax", "ymax")] == [0, 0, 25, 10] and got[1]["attributes"] == {"label": "Tree"} and got[3]["attributes"] == {"label": None}
    ann = vector.annotations(vector.read_shapefile(spark, str(tmp_path))).orderBy("ann_id").collect()
    assert [(a["image_path"], a["label"]) for a in ann] == [("one.tif", "Tree"), ("one.tif", None)]
    _shapefile(tmp_path, "two", [(3.0, 4.0)], ["P"])
    two = readers.read_annotations(spark, f"{tmp_path}/two.shp").first()
    assert (two["x"], two["y"], two["label"], two["image_path"], two["root_dir"]) == (3.0, 4.0, "P", "two.tif", str(tmp_path))
    assert readers.read_annotations(spark, f"{tmp_path}/one.shp", label="T").where("label = 'T' and xmax > 0").count() == 2
    with pytest.raises(ValueError, match="kind of geometry"):
        vector.annotations(vector.read_shapefile(spark, str(tmp_path)))
    (tmp_path / "two.prj").write_text('GEOGCS["WGS 84"]')
    with pytest.raises(ValueError, match="geographic"):
        vector.read_shapefile(spark, str(tmp_path))


def test_geopackages(spark, tmp_path):
    import sqlite3
    import struct

    def polygon(order, rings, height=False):
        out = struct.pack(f"{order}bII", order == "<", 3 + 1000 * height, len(rings))
        return out + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}{2 + height}d", *p, *([7.0] * height)) for p in r) for r in rings)

    head = lambda envelope=b"", flags=1: struct.pack("<2sbbi", b"GP", 0, flags, 32616) + envelope
    multi = struct.pack("<bII", 1, 6, 2) + polygon("<", HOLED[:2]) + polygon(">", HOLED[2:])
    rows = [(head() + multi, "Tree"), (head(bytes(32), 3) + polygon("<", HOLED[:1], True), None), (None, "none"), (head(flags=0x11), "empty")]
    with sqlite3.connect(tmp_path / "a.gpkg") as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER)")
        db.execute("CREATE TABLE f (fid INTEGER PRIMARY KEY, geom BLOB, label TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('f', 'geom', 32616)")
        db.executemany("INSERT INTO f (geom, label) VALUES (?, ?)", rows)
    db.close()
    got = {r["fid"]: r for r in vector.read_geopackage(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2] and [len(p) for p in got[1]["rings"]] == [2, 1] and got[1]["attributes"]["label"] == "Tree"
    assert [got[2][c] for c in ("xmin", "ymin", "xmax", "ymax")] == [0, 0, 10, 10] and got[2]["attributes"]["label"] is None
    assert vector.from_wkb(struct.pack("<bI2d", 1, 1, 3.0, 4.0), "p", 1)[2:5] == ("point", 3.0, 4.0)
    with pytest.raises(ValueError, match="not supported"):
        vector.from_wkb(struct.pack("<bII", 1, 2, 0), "line", 1)


def test_windows_and_split(spark):
    images = spark.createDataFrame([("a.png", 400, 400), ("b.png", 200, 500)], "image_path string, width int, height int")
    w = tiling.windows(images, 300, 0.0)
    assert w.where("image_path = 'a.png'").count() == 4 and w.where("window_w = 300 and window_h = 300").count() == 4
    none = spark.createDataFrame([], BOX)
    out = tiling.split_annotations(none, w.where("image_path = 'a.png'"), allow_empty=True, empty_label="T").collect()
    assert len(out) == 4 and all(r["xmin"] + r["ymin"] + r["xmax"] + r["ymax"] == 0 for r in out)
    with pytest.raises(ValueError):
        tiling.windows(images, 300, 1.5)
    p = spark.createDataFrame([(0, "a.png", 300.0, 10.0, "T", None)], POINT)
    assert tiling.points_per_window(p, w).count() == 2
    wide = spark.createDataFrame([("c.png", 1500, 1300)], "image_path string, width int, height int")
    tiles = tiling.windows(wide, 500, 0.2)
    own = [(r["window_xmin"], r["window_ymin"]) for r in tiles.collect()]
    xy = np.random.default_rng(5).integers(0, 1300, (60, 2)).astype(float)
    d = spark.createDataFrame([(i, "c.png", float(x), float(y), float(x + 120), float(y + 70), "T", None) for i, (x, y) in enumerate(xy)], BOX)
    kept = sorted((r["ann_id"], r["window_xmin"], r["window_ymin"]) for r in tiling.annotations_per_window(d, tiles).collect())
    share = lambda low, size, start: max(min(low + size, start + 500) - max(low, start), 0)
    assert kept == sorted((i, a, b) for i, (x, y) in enumerate(xy) for a, b in own if share(x, 120, a) * share(y, 70, b) > 0.5 * 120 * 70)


def test_nms_keeps_more_at_higher_thresholds(spark):
    rng = np.random.default_rng(0)
    xy = rng.integers(0, 200, (120, 2)).astype(float)
    d = spark.createDataFrame([(i, "a", float(x), float(y), float(x + 30), float(y + 30), "AB"[i % 2], float(s)) for i, ((x, y), s) in enumerate(zip(xy, rng.random(120), strict=True))], BOX)
    kept = [suppress.nms(d, t).count() for t in (0.05, 0.3, 0.6, 1.0)]
    assert kept == sorted(kept) and kept[-1] == 120
    assert suppress.nms_where_classes_mix(d, 0.3).count() == kept[1]
    assert suppress.top_k(d, 7).count() == 7


def greedy(rows, clash):
    """Plain greedy suppression of (rank key, shape) rows; positions kept."""
    kept = []
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        if not any(clash(rows[i][1], rows[k][1]) for k in kept):
            kept.append(i)
    return sorted(kept)


def test_suppression_across_cells(spark):
    """Small cells, so that most boxes lie on borders and several rounds are needed; ties, repeats and an image of its own for null."""
    rng = np.random.default_rng(3)
    n = 150
    xy, size, score = rng.integers(-50, 200, (n, 2)).astype(float), rng.integers(5, 90, (n, 2)).astype(float), rng.integers(0, 40, n).astype(float)
    image = rng.choice(["a", "b", None], n, p=[0.7, 0.2, 0.1])
    rows = [(int(i), image[i], *map(float, (*xy[i], *(xy[i] + size[i]))), "T", float(score[i])) for i in range(n)]
    rows += [rows[0], rows[1]]

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        common = max(w, 0) * max(h, 0)
        return a[0] == b[0] and common / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - common) > 0.2

    def near(a, b):
        return a[0] == b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 20.0**2

    want = greedy([((-r[7], r[0], k), r[1:6]) for k, r in enumerate(rows)], iou)
    d = spark.createDataFrame(rows, BOX)
    for cell in (64, 4096):
        assert sorted(r["ann_id"] for r in suppress.nms(d, 0.2, cell=cell).collect()) == sorted(rows[k][0] for k in want)
    points = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[6], r[7]) for r in rows], POINT)
    want = greedy([((-r[7], r[0], k), r[1:4]) for k, r in enumerate(rows)], near)
    assert sorted(r["ann_id"] for r in suppress.suppress_points(points, 20.0, cell=64).collect()) == sorted(rows[k][0] for k in want)
    odd = spark.createDataFrame([(0, "a", None, 0.0, 1.0, 1.0, "T", 0.5), (1, "a", 0.0, 0.0, 1.0, 1.0, None, None)], BOX)
    assert suppress.nms(odd).count() == 2 and suppress.nms(odd.limit(0)).count() == 0 and suppress.suppress_points(points, 0).count() == len(rows)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(50):
        c = rng.integers(0, 20, (4, 5)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        assert math.isclose(sum(c[i, j] for i, j in matching.assign(c)), best)
        assert math.isclose(sum(c.T[i, j] for i, j in matching.assign(c.T)), best)


def test_coordinates_turn_around(spark):
    images = spark.createDataFrame([("a", 10.0, 90.0, 0.5)], "image_path string, left double, top double, res double")
    d = spark.createDataFrame([(0, "a", 2.0, 4.0, 6.0, 8.0, "T", None)], BOX)
    r = coords.geo_to_image(coords.image_to_geo(d, images, offset=0.0), images).first()
    assert (r["xmin"], r["ymin"], r["xmax"], r["ymax"]) == (2, 4, 6, 8)
    r = coords.geo_to_image(coords.image_to_geo(d, images), images).first()
    assert (r["xmin"], r["ymin"]) == (2.5, 4.5)
    with pytest.raises(ValueError):
        coords.reject_geographic(4326)


def test_checks(spark):
    images = spark.createDataFrame([("a", 100, 100)], "image_path string, width int, height int")
    d = spark.createDataFrame([(0, "a", 0.0, 0.0, 0.0, 0.0, "T", None), (1, "a", -1.0, 0.0, 50.0, 101.0, "T", None), (2, "x", 1.0, 1.0, 5.0, 5.0, "T", None)], BOX)
    got = {r["ann_id"]: r["issues"] for r in validate.box_issues(d, images).collect()}
    assert got == {1: ["xmin < 0", "ymax > height"], 2: ["unknown image"]}
    with pytest.raises(ValueError):
        validate.raise_if(validate.box_issues(d, images), "boxes")
    assert not validate.outside_raster(d, 100, 100) and validate.outside_raster(d, 100, 50)


def test_polygons(spark):
    r = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))",), ("MULTIPOLYGON (((0 0, 1 0, 1 1)), ((5 5, 6 5, 6 6)))",)], "w string").select(polygons.parse_wkt(F.col("w")).alias("p")).collect()
    assert [len(x["p"]) for x in r] == [1, 2] and r[0]["p"][0][0][2]["y"] == 3
    area = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))",)], "w string").select(polygons.ring_area(polygons.parse_wkt(F.col("w"))[0][0]).alias("a")).first()["a"]
    assert area == 12
    sq = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    assert math.isclose(polygons.overlap(sq(0, 0, 4), sq(2, 2, 4)), 4)
    ell = np.array([[0, 0], [4, 0], [4, 2], [2, 2], [2, 4], [0, 4]], float)
    assert math.isclose(polygons.overlap(ell, sq(1, 1, 3)), 5)
    assert polygons.signed_area(polygons.clip(sq(0, 0, 4), (1, 1, 3, 9))) == 6
    assert runs.fill([[sq(1, 1, 3)]], 6, 6).tolist() == [[y, 1, 5] for y in range(1, 5)]  # points on the border belong to it


def test_density_and_peaks(spark):
    p = spark.createDataFrame([(0, "a", 10.0, 12.0, "T", None), (1, "a", 40.0, 30.0, "T", None)], POINT)
    grid = density.density(p, 64, 64, 2.0)
    assert math.isclose(grid.agg(F.sum("value")).first()[0], 2.0, rel_tol=1e-9)
    assert sorted((r["x"], r["y"]) for r in density.peaks(grid, 0.5, 2).collect()) == [(10, 12), (40, 30)]
    plan = density.sinkhorn(np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.array([[0.0, 1.0], [1.0, 0.0]]), 0.05)
    assert np.allclose(plan, [[0.5, 0], [0, 0.5]], atol=1e-3)
    assert density.transport_cost(p, p, 0.01).first()["cost"] < 1e-6


def test_average_precision(spark):
    t = spark.createDataFrame([(0, "a", 0.0, 0.0, 10.0, 10.0, "T", None), (1, "a", 50.0, 50.0, 60.0, 60.0, "T", None)], BOX)
    p = spark.createDataFrame([(0, "a", 0.0, 0.0, 10.0, 10.0, "T", 0.9), (1, "a", 80.0, 80.0, 90.0, 90.0, "T", 0.5)], BOX)
    got = precision.average_precision(t, p, (0.5,)).first()["ap"]
    assert math.isclose(got, 51 / 101)


def test_scorer(spark):
    images = spark.createDataFrame([("a", 700, 400)], "image_path string, width int, height int")

    def scorer(w: pd.DataFrame) -> pd.DataFrame:  # finds one object at (390, 100), wherever a window shows it
        w = w[(w.window_xmin <= 390) & (w.window_xmin + w.window_w >= 410)]
        return pd.DataFrame({"image_path": w.image_path, "window_index": w.window_index, "window_xmin": w.window_xmin, "window_ymin": w.window_ymin, "xmin": 390.0 - w.window_xmin, "ymin": 100.0 - w.window_ymin, "xmax": 410.0 - w.window_xmin, "ymax": 120.0 - w.window_ymin, "label": "T", "score": 0.5, "ann_id": w.window_index.astype("int64")})

    r = predict_tile(images, scorer, overlap=0.25).collect()
    assert [(x["xmin"], x["ymax"]) for x in r] == [(390, 120)]


def test_config():
    c = config.load({"patch_size": 512, "validation": {"iou_threshold": 0.5}}, {"label_dict": {"Bird": 0, "Nest": 1}})
    assert (c.patch_size, c.validation.iou_threshold, c.label_dict) == (512, 0.5, {"Bird": 0, "Nest": 1})
    for bad in ({"nope": 1}, {"label_dict": {"a": 0, "b": 0}}):
        with pytest.raises(ValueError):
            config.load(bad)


def test_server_kinds_and_tiles(spark):
    assert readers.web_kind("https://h/arcgis/rest/services/x/ImageServer") == "arcgis"
    assert readers.web_kind("https://h/{z}/{x}/{y}.png") == "tiles"
    with pytest.raises(ValueError):
        readers.web_kind("https://h/")
    assert readers.tiles_of((0.0, 0.0, 10.0, 10.0), 4, spark).count() >= 1


def test_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")).selectExpr("ts", "event_type as label", "value as score")
    q = running_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == e.count()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return c


def plain(frame: pd.DataFrame) -> list:
    cell = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x
    return sorted((tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_matches_hold_their_invariants(spark):
    pairs = registry.QUERIES["match_boxes"](spark, "/root/testdata/sf0.001")
    assert pairs.groupBy("truth_id").count().where("count > 1").count() == 0
    assert pairs.where("prediction_id is not null").groupBy("prediction_id").count().where("count > 1").count() == 0
    alone = registry.QUERIES["match_boxes_unique"](spark, "/root/testdata/sf0.001").selectExpr("t_ann_id as truth_id", "p_ann_id as prediction_id")
    assert alone.join(pairs, ["truth_id", "prediction_id"], "left_anti").count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.SQL) <= set(__spark_entry__.oracle_sql())


def _by_enumeration(weight):
    """Greatest total of a one-to-one choice, over all ways."""
    n, m = len(weight), len(weight[0]) if weight else 0
    if n > m:
        return _by_enumeration([list(c) for c in zip(*weight, strict=True)])
    return max((sum(weight[i][j] for i, j in enumerate(c)) for c in itertools.permutations(range(m), n)), default=0)


def test_evaluation_on_the_real_assignment(spark):
    rng = random.Random(4)
    rows = []
    for image in range(12):
        for k in range(rng.randint(1, 5)):
            for side in (True, False):
                x, y = rng.randrange(60), rng.randrange(60)
                rows.append((len(rows), f"i{image}", x, y, x + rng.randint(10, 40), y + rng.randint(10, 40), rng.choice("ab"), rng.random(), side))
    rows.append((len(rows), "empty", 0, 0, 0, 0, "a", 0.0, True))
    d = spark.createDataFrame(rows, "ann_id long, image_path string, xmin int, ymin int, xmax int, ymax int, label string, score double, t boolean")
    truth, pred = d.where("t").drop("t"), d.where("not t").drop("t")
    for crowded in (1_000_000, 0):  # by image and by component
        pairs = matching.iou_pairs(truth, pred)
        got = matching.assign_pairs(pairs, crowded=crowded).join(pairs, ["image_path", "t_ann_id", "p_ann_id"]).groupBy("image_path").sum("inter").collect()
        total = {r[0]: r[1] for r in got}
        common = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        for image in range(12):
            own = [r for r in rows if r[1] == f"i{image}"]
            weight = [[common(a, b) for b in own if not b[8]] for a in own if a[8]]
            assert total.get(f"i{image}", 0) == _by_enumeration(weight)
    out = evaluate.evaluate(pred, truth)
    results = out["results"].toPandas()
    assert len(results) == sum(r[8] for r in rows) - 1 and "empty" not in set(results["image_path"])
    hits = results[results["IoU"] > 0.4].groupby("image_path").size()
    n_t, n_p = ({f"i{i}": sum(r[1] == f"i{i}" and r[8] == s for r in rows) for i in range(12)} for s in (True, False))
    macro = out["macro"].first()
    assert abs(macro["recall"] - sum(hits.get(k, 0) / n_t[k] for k in n_t) / 12) < 1e-9
    assert abs(macro["precision"] - sum(hits.get(k, 0) / n_p[k] for k in n_p) / 12) < 1e-9
    none = evaluate.evaluate(pred.where("false"), truth)["macro"].first()
    assert none["recall"] == 0 and none["precision"] is None
    bare = evaluate.evaluate(pred, truth.where("image_path = 'empty'"))["macro"].first()
    assert bare["recall"] is None and bare["precision"] == 0


def test_average_precision_of_missing_labels(spark):
    cols = "ann_id long, image_path string, xmin int, ymin int, xmax int, ymax int, label string, score double"
    truth = spark.createDataFrame([(1, "i", 0, 0, 10, 10, "a", 1.0), (2, "i", 20, 20, 30, 30, "b", 1.0), (3, "j", 0, 0, 10, 10, "a", 1.0)], cols)
    pred = spark.createDataFrame([(4, "i", 0, 0, 10, 10, "a", 0.9), (5, "i", 0, 0, 10, 10, "a", 0.8), (6, "k", 0, 0, 5, 5, "c", 0.7)], cols)
    got = {(r["label"], r["threshold"]): (r["ap"], r["ar"]) for r in precision.average_precision(truth, pred).collect()}
    assert set(got) == {(x, t) for x in "ab" for t in precision.LEVELS}
    assert all(got["b", t] == (0.0, 0.0) for t in precision.LEVELS)
    assert all(abs(got["a", t][0] - 51 / 101) < 1e-9 and got["a", t][1] == 0.5 for t in precision.LEVELS)
    s = precision.detection_summary(truth, pred).first()
    assert abs(s["map"] - 51 / 202) < 1e-9 and s["mar_1"] == 0.25


def test_draws_follow_weights(spark):
    rows = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") < 10, 3.0).otherwise(F.when(F.col("id") < 20, 0.0).otherwise(1.0)).alias("weight"))
    for n in (1, 7):
        got = sampling.weighted_draws(rows.repartition(n), 5000, ("k",), seed=3).collect()
        assert len(got) == 5000 == len({r["draw"] for r in got})
        heavy = sum(r["k"] < 10 for r in got)
        assert abs(heavy / 5000 - 0.6) < 0.04 and not any(10 <= r["k"] < 20 for r in got)
        assert n == 1 or sorted((r["draw"], r["k"]) for r in got) == last
        last = sorted((r["draw"], r["k"]) for r in got)


def test_polygons_as_frames(spark):
    wkt = ["POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", "POLYGON ((5 -5, 15 5, 5 15, -5 5, 5 -5))", "POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))", "POLYGON ((0 0, 10 0, 5 1, 5 10, 0 0))"]
    d = spark.createDataFrame([(k, "i", w, "a", 0.5) for k, w in enumerate(wkt)], "ann_id long, image_path string, wkt string, label string, score double").withColumn("rings", polygons.parse_wkt(F.col("wkt")))
    sizes = {r["ann_id"]: r["a"] for r in d.select("ann_id", polygons.area(F.col("rings")).alias("a")).collect()}
    assert sizes[0] == 96 and sizes[1] == 200
    got = polygons.overlap_pairs(d.where("ann_id = 0"), d.where("ann_id = 1")).first()
    assert abs(got["inter"] - 96) < 1e-6 and abs(got["iou"] - 96 / 200) < 1e-6
    images = spark.createDataFrame([("i", 12, 12)], "image_path string, width int, height int")
    issues = {r["ann_id"]: r["issues"] for r in polygons.polygon_issues(d, images).collect()}
    assert 0 not in issues and "xmin < 0" in issues[1] and "xmax > width" in issues[1] and "sides cross" in issues[2] and 3 not in issues
    wins = spark.createDataFrame([("i", 0, 0, 0, 8, 8), ("i", 1, 9, 9, 8, 8)], "image_path string, window_index int, window_xmin int, window_ymin int, window_w int, window_h int")
    cut = polygons.per_window(d.where("ann_id = 0").select("ann_id", "image_path", "rings"), wins).collect()
    assert [(r["window_index"], r["xmax"]) for r in cut] == [(0, 8.0)]
    assert [sum(r["mask"]) for r in runs.pixels(runs.masks(d.where("ann_id = 0"), images), images).collect()] == [121]
    assert matching.match_predictions(d, d, "polygon").where("truth_id <> prediction_id").count() <= 4


def test_split_raster_errors(spark):
    ann = spark.createDataFrame([(1, "i", 10, 10, 60, 60, "a")], "ann_id long, image_path string, xmin int, ymin int, xmax int, ymax int, label string")
    images = spark.createDataFrame([("i", 400, 400), ("j", 400, 400)], "image_path string, width int, height int")
    with pytest.raises(ValueError):
        tiling.split_raster(ann, images, patch=500)
    with pytest.raises(ValueError):
        tiling.split_raster(ann, images)
    assert tiling.split_raster(ann, images, allow_empty=True, empty_label="a").count() == 2
    assert tiling.split_raster(ann, images.where("image_path = 'i'")).count() == 1


def _images(folder):
    """Two PPM and one PGM file; pixels by name."""
    rng, made = np.random.default_rng(5), {}
    for name, shape in (("a.ppm", (30, 40, 3)), ("b.ppm", (9, 7, 3)), ("c.pgm", (12, 12, 1))):
        made[name] = rng.integers(0, 256, shape, dtype=np.uint8)
        head = f"{'P6' if shape[2] == 3 else 'P5'}\n# made here\n{shape[1]} {shape[0]}\n255\n"
        (folder / name).write_bytes(head.encode() + made[name].tobytes())
    return made


def test_images_and_crops(spark, tmp_path):
    made, path = _images(tmp_path), str(tmp_path / "*.p*m")
    sizes = rasters.image_sizes(spark, path)
    assert {(r["image_path"], r["width"], r["height"]) for r in sizes.collect()} == {("a.ppm", 40, 30), ("b.ppm", 7, 9), ("c.pgm", 12, 12)}
    wins = tiling.windows(sizes, 8, 0.25).unionByName(rasters.whole_images(sizes).withColumn("window_index", F.lit(1000))).unionByName(tiling.windows_padded(sizes, 10, 0.2).withColumn("window_index", F.col("window_index") + 2000))
    got = rasters.crops(spark, path, wins).collect()
    assert len(got) == wins.count()
    for r in got:
        image = np.repeat(made[r["image_path"]], 3, axis=2)[:, :, :3] if r["image_path"] == "c.pgm" else made[r["image_path"]]
        x, y, w, h = r["window_xmin"], r["window_ymin"], r["window_w"], r["window_h"]
        want = np.zeros((h, w, 3))
        part = image[y : y + h, x : x + w]
        want[: part.shape[0], : part.shape[1]] = part / 255
        assert np.allclose(np.array(r["pixels"]).reshape(3, h, w), want.transpose(2, 0, 1), atol=1e-6)


def test_many_windows_of_one_image_are_several_reads(spark, tmp_path, monkeypatch):
    _images(tmp_path)
    monkeypatch.setattr(rasters, "PER_READ", 5)
    wins = tiling.windows(spark.createDataFrame([("a.ppm", 40, 30)], "image_path string, width int, height int"), 4, 0.5)
    got = rasters.crops(spark, str(tmp_path / "a.ppm"), wins).select("window_index").collect()
    assert len(got) == wins.count() > 100 and len({r["window_index"] for r in got}) == len(got)


def test_crop_windows(spark, tmp_path):
    _images(tmp_path)
    b = "image_path string, window_index int, left double, bottom double, right double, top double"
    plain = spark.createDataFrame([("a.ppm", 40, 30)], "image_path string, width int, height int")
    placed = plain.selectExpr("*", "100D as left", "500D as top", "0.5D as res")
    box = lambda df: [tuple(r)[2:] for r in df.collect()]
    assert box(rasters.crop_windows(spark.createDataFrame([("a.ppm", 0, 101.0, 495.0, 105.0, 499.0)], b), placed)) == [(2, 2, 8, 8)]
    assert box(rasters.crop_windows(spark.createDataFrame([("a.ppm", 0, -3.0, 2.0, 90.0, 8.5)], b), plain)) == [(0, 2, 40, 7)]
    with pytest.raises(Exception, match="no pixels"):
        rasters.crop_windows(spark.createDataFrame([("a.ppm", 0, 900.0, 495.0, 905.0, 499.0)], b), placed).collect()
    for bad in (b"P6\n1 1\n65535\nxxxxxx", b"P3\n1 1\n255\n1 2 3", b"P6\n1"):
        with pytest.raises(ValueError):
            rasters.read_pnm(bad)
    with pytest.raises(ValueError):
        rasters.as_rgb(np.zeros((2, 2, 2)))


def test_write_crops(spark, tmp_path):
    _images(tmp_path)
    ann = spark.createDataFrame([(7, "a.ppm", 2, 3, 8, 7, "x"), (9, "a.ppm", 0, 0, 0, 0, "x"), (11, "b.ppm", 1, 1, 4, 9, "y")], "ann_id long, image_path string, xmin int, ymin int, xmax int, ymax int, label string")
    path, out = str(tmp_path / "*.p*m"), str(tmp_path / "out")
    rasters.write_crops(spark, path, rasters.label_crops(ann, rasters.image_sizes(spark, path)), out)
    got = {r["crop_path"]: (r["window_w"], r["window_h"], len(r["pixels"])) for r in spark.read.parquet(out).collect()}
    assert got == {"x/a_7.png": (6, 6, 108), "y/b_11.png": (7, 7, 147)}


def test_places_of_draws_are_found_by_halves(spark):
    for n in (1, 2, 5, 8, 1000):
        at = [float(k // 2) for k in range(n)]
        rows = spark.range(-1, n + 2).select((F.col("id") / 2.0).alias("v"))
        found = sampling._last_up_to(F.array(*map(F.lit, at)), n, F.col("v"))
        assert all(r["k"] == sum(a <= r["v"] for a in at) - 1 for r in rows.select("v", found.alias("k")).collect())


def test_boxes_of_images_without_points_are_not_dealt_to_cells(spark):
    points = spark.createDataFrame([(0, "a", 5.0, 30.0, "T", None)], POINT)
    far = 1e9  # as many cells would end any job
    truth = spark.createDataFrame([(0, "a", 1.0, 1.0, 100.0, 50.0, "T", None), (1, "b", 0.0, 0.0, far, far, "T", None)], BOX)
    assert [(r["ann_id"], r["t_ann_id"]) for r in matching.points_in_boxes(points, truth).collect()] == [(0, 0)]
