"""Polygons as geometry: by point sampling, by areas, and where sides coincide."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyx.operators import overlay, polygons
from canopyx.sources import readers

RINGS = "array<array<array<struct<x: double, y: double>>>>"


def star(rng, grid, centre=(0, 0)):
    n = rng.integers(3, 12)
    t, r = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(3, 10, n)
    p = np.stack([r * np.cos(t), r * np.sin(t)], 1) + centre
    return np.round(p * grid) / grid if grid else p


def within(parts, point):
    return any(sum(overlay.contains(r, point) for r in part) % 2 for part in parts)


@pytest.mark.parametrize("grid", [0, 1, 4])
def test_against_points(grid):
    """Also on a coarse grid, where sides coincide and vertices lie on sides."""
    rng = np.random.default_rng(grid)
    for k in range(250):
        a, b = [[star(rng, grid)]], [[star(rng, grid, rng.uniform(-6, 6, 2).round())]]
        b = [[a[0][0][::-1]]] if k % 11 == 0 else [[a[0][0] + (2.0, 0)]] if k % 7 == 0 else [[a[0][0] / 2], *b] if k % 5 == 0 else b
        both, either, left = overlay.intersection(a, b), overlay.union([*a, *b]), overlay.difference(a, b)
        own = [overlay.area(overlay.union(x)) for x in (a, b)]
        assert abs(overlay.area(either) + overlay.area(both) - sum(own)) < 1e-6 and abs(overlay.area(left) + overlay.area(both) - own[0]) < 1e-6
        for part in [*both, *either, *left]:
            assert overlay.is_valid(part) and overlay._signed(part[0]) > 0 and all(overlay._signed(h) < 0 for h in part[1:])
        for point in rng.uniform(-14, 14, (12, 2)):
            x, y = within(a, point), within(b, point)
            assert (within(both, point), within(either, point), within(left, point)) == (x and y, x or y, x and not y)


def box(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)


def test_known_shapes():
    whole = [[box(0, 0, 10, 10)]]
    assert overlay.intersection(whole, [[box(10, 0, 20, 10)]]) == [] and overlay.intersection(whole, []) == [] and overlay.union([]) == []
    (side,) = overlay.union([*whole, [box(10, 0, 20, 10)]])
    assert len(side) == 1 and len(side[0]) == 4 and overlay.area([side]) == 200
    assert len(overlay.union([*whole, [box(10, 10, 20, 20)]])) == 2  # they touch in a point
    (frame,) = overlay.difference(whole, [[box(2, 2, 4, 4)], [box(6, 6, 8, 8)]])
    assert len(frame) == 3 and overlay.area([frame]) == 92
    assert len(overlay.difference(whole, [[box(4, -1, 6, 11)]])) == 2
    (again,) = overlay.union([frame, [box(1, 1, 5, 5)]])
    assert len(again) == 2 and overlay.area([again]) == 96
    far = [[r + 1e6 for r in frame]]
    assert abs(overlay.area(overlay.intersection(far, [[box(1e6, 1e6, 1e6 + 3, 1e6 + 3)]])) - 8) < 1e-6
    nested = overlay.union([frame, [box(2.5, 2.5, 3, 3)]])  # an island in a hole
    assert len(nested) == 2 and abs(overlay.area(nested) - 92.25) < 1e-9


def test_validity():
    bow = np.array([(0, 0), (10, 10), (10, 0), (0, 10)], float)
    spike = np.array([(0, 0), (10, 0), (20, 0), (10, 0), (10, 10)], float)
    back = np.array([(0, 0), (10, 0), (5, 0), (5, 10)], float)
    touch = np.array([(0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5)], float)
    for ring in (bow, spike, back, touch, bow[:2], np.array([(0, 0), (5, 5), (10, 10)], float), box(0, 0, 0, 5), np.array([(0, 0), (np.nan, 1), (1, 0)])):
        assert not overlay.is_simple(ring)
    assert overlay.is_simple(box(0, 0, 1, 1)) and overlay.is_simple(np.concatenate([box(0, 0, 1, 1), [[0, 0]]]))
    border = box(0, 0, 10, 10)
    assert overlay.is_valid([border, box(2, 2, 4, 4), box(4, 4, 6, 6)])  # holes that touch in a point
    for holes in ([box(8, 8, 12, 12)], [box(2, 2, 5, 5), box(4, 4, 6, 6)], [box(20, 20, 22, 22)], [box(0, 4, 10, 6)]):
        assert not overlay.is_valid([border, *holes])


def rows(spark, shapes):
    dress = lambda parts: parts and [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in parts]
    return spark.createDataFrame([(k, "i", dress(p)) for k, p in enumerate(shapes)], f"ann_id long, image_path string, rings {RINGS}")


def test_pairs(spark):
    comb = np.array([(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)], float)
    left, right = rows(spark, [[[comb]], None, []]), rows(spark, [[[box(-1, 5, 11, 7)]], [[box(3, 3, 7, 9)]], [[box(50, 50, 60, 60)]]])
    (both,) = overlay.overlay_pairs(left, right).collect()
    assert (both["t_ann_id"], both["p_ann_id"], both["area"], len(both["rings"])) == (0, 0, 8.0, 2)  # a concave shape is cut apart
    sums = {(r["p_ann_id"]): round(r["area"], 9) for r in overlay.overlay_pairs(left, right, "union").collect()}
    assert sums == {0: 52 + 24 - 8, 1: 52 + 24}
    assert {r["p_ann_id"]: r["area"] for r in overlay.overlay_pairs(left, right, "difference").collect()} == {0: 44.0, 1: 52.0}


def test_windows_cut_apart(spark):
    comb = np.array([(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)], float)
    windows = spark.createDataFrame([("i", 0, 0, 3, 20, 20), ("i", 1, 0, 0, 20, 20)], "image_path string, window_index int, window_xmin int, window_ymin int, window_w int, window_h int")
    got = {r["window_index"]: r for r in polygons.per_window(rows(spark, [[[comb]]]), windows, 0.3).collect()}
    assert len(got[0]["rings"]) == 2 and (got[0]["ymin"], got[0]["ymax"]) == (0.0, 7.0) and len(got[1]["rings"]) == 1
    area = lambda r: sum(polygons.signed_area(np.array([(v["x"], v["y"]) for v in p[0]])) for p in r["rings"])
    assert (abs(area(got[0])), abs(area(got[1]))) == (28.0, 52.0)


def test_coco_parts(spark, tmp_path):
    flat = lambda r: np.asarray(r, float).ravel().tolist()
    bow = [(0, 0), (10, 10), (10, 0), (0, 10)]
    ann = [
        {"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 15, 10], "area": 3, "segmentation": [flat(box(0, 0, 10, 10)), flat(box(5, 0, 15, 10))]},
        {"id": 2, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4], "segmentation": [flat(bow)]},
        {"id": 3, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "segmentation": [flat(bow), flat(box(0, 0, 2, 2)), [1, 2, 3, 4]]},
        {"id": 4, "image_id": 9, "category_id": 1, "bbox": [0, 0, 1, 1], "segmentation": {"counts": [1], "size": [1, 1]}},
        {"id": 5, "image_id": 9, "category_id": 1, "segmentation": [flat(box(0, 0, 2, 2)), flat(box(8, 8, 9, 9))]},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "x/a.png", "width": 20, "height": 20}], "categories": [{"id": 1, "name": "Tree"}], "annotations": ann}))
    got = {r["ann_id"]: r for r in readers.read_coco(spark, str(tmp_path / "a.json")).withColumn("own", polygons.area(F.col("rings"))).collect()}
    assert set(got) == {1, 3, 5}
    assert (len(got[1]["rings"]), got[1]["own"], got[1]["xmax"], got[1]["area"]) == (1, 150.0, 15.0, 3.0)
    assert (len(got[3]["rings"]), got[3]["own"], got[3]["label"], got[3]["xmin"], got[3]["ymax"]) == (1, 4.0, None, 1.0, 6.0)
    assert (len(got[5]["rings"]), got[5]["image_path"], got[5]["xmax"]) == (2, None, 9.0)


def test_intersections_without_geometry(spark):
    rng = np.random.default_rng(8)
    stairs = lambda x, y: np.array([(x, y), (x + 9, y), (x + 9, y + 3), (x + 5, y + 3), (x + 5, y + 6), (x + 2, y + 6), (x + 2, y + 9), (x, y + 9)], float)
    comb = np.array([(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10), (0, 0)], float)
    shapes = [[[comb]], [[box(0, 0, 12, 12), box(3, 3, 8, 9)]], [[box(0, 0, 4, 4)], [box(2, 2, 7, 7)]], [[star(rng, 1, (6, 6))]], [[star(rng, 0, (3, 8))]], [[]], []]
    shapes += [[[stairs(*rng.integers(0, 8, 2))[:: 1 - 2 * (k % 2)]]] for k in range(6)]
    left, right = rows(spark, [*shapes, None]), rows(spark, [*shapes[::-1], [[box(10, 0, 12, 10)]]])
    names = ("area", "xmin", "ymin", "xmax", "ymax")
    figures = lambda d: {(r["t_ann_id"], r["p_ann_id"]): [round(r[c], 6) for c in names] for r in d.collect()}
    want = figures(polygons.with_bounds(overlay.overlay_pairs(left, right)))
    found = overlay.intersections(left, right)
    assert figures(found) == want and len(want) > 90
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString() and "Join" not in found._jdf.queryExecution().executedPlan().toString()
