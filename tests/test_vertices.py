"""Polygons by the batch against the same work one ring at a time."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canopyx.operators import polygons, vertices


def _rings(seed, n=200, m=5, concave=False):
    rng = np.random.default_rng(seed)
    turn = np.sort(rng.random((n, m)), axis=1) * 2 * np.pi
    far = rng.random((n, m, 1)) * 4 + 1 if concave else 4.0
    return np.round(np.stack([np.cos(turn), np.sin(turn)], axis=2) * far + rng.random((n, 1, 2)) * 5, 2)


def test_parse_areas_and_bounds():
    got = vertices.parse(pa.array(["POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0), (1 1, 2 1, 2 2))", None, " MULTIPOLYGON Z(((0 0 1, 1 0 1, 1 1 1)), ((5 5 2, 6 5 2,6 6.5 2)))"]))
    assert [None if r is None else [[len(ring) for ring in part] for part in r] for r in got.to_pylist()] == [[[5, 3]], None, [[3], [3]]]
    for some, n in ((got, 3), (got.slice(2), 1)):
        at = vertices.Rings(some)
        assert at.areas()[-1] == 1.25 and at.bounds()[0][-1].tolist() == [0, 0, 6, 6.5] and len(at.areas()) == n
    assert vertices.Rings(got).areas()[:2].tolist() == [11.5, 0] and vertices.Rings(got).bounds()[1].tolist() == [True, False, True]
    for wrong in ("LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 1 1", "POLYGON ((0 0, 1, 2 2))", "POLYGON ((0 0, a b, 2 2))"):
        with pytest.raises(ValueError):
            vertices.parse(pa.array([wrong]))


def test_cuts_equal_those_of_single_rings():
    for concave in (False, True):
        a, b = _rings(1, concave=concave), vertices.turned(_rings(2))
        n = np.full(len(a), a.shape[1])
        got, left = vertices.cut_box(a, n, np.tile([0.0, 1.0, 5.0, 4.0], (len(a), 1)))
        for k in range(len(a)):
            assert np.array_equal(got[k, : left[k]], polygons.clip(a[k], (0, 1, 5, 4)))
            assert vertices.convex(vertices.turned(a[k : k + 1]))[0] == polygons.convex(a[k])
        fit = vertices.convex(b)
        inter = np.abs(vertices.signed(*vertices.cut_convex(vertices.turned(a[fit]), n[fit], b[fit])))
        assert fit.any() and np.allclose(inter, [polygons.overlap(r, s) for r, s in zip(a[fit], b[fit], strict=True)], atol=1e-9)


def test_windows_and_pairs_take_convex_rings_by_the_batch(spark):
    shape = lambda rings: [[[(float(x), float(y)) for x, y in r]] for r in rings]
    a, b = _rings(3, 60), _rings(4, 60, concave=True)
    rows = [(k, "i", shape([r])) for k, r in enumerate([*a, *b])] + [(900, "i", shape([a[0], b[1] + 20])), (901, "i", None)]
    d = spark.createDataFrame(rows, "ann_id long, image_path string, rings array<array<array<struct<x: double, y: double>>>>")
    rings = {k: [np.array(p[0]) for p in s] for k, _, s in rows if s}
    truth, pred = d.where("ann_id % 2 = 0"), d.where("ann_id % 2 = 1")
    want = {(s, t): sum(polygons.overlap(p, q) for p in rings[s] for q in rings[t]) for s in rings for t in rings if s % 2 == 0 and t % 2}
    got = {(r["t_ann_id"], r["p_ann_id"]): r["inter"] for r in polygons.overlap_pairs(truth, pred).collect()}
    assert set(got) == {k for k, v in want.items() if round(v, 9) > 1e-9} and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    wins = spark.createDataFrame([("i", 0, 0, 0, 4, 4), ("i", 1, 2, 1, 30, 30)], "image_path string, window_index int, window_xmin int, window_ymin int, window_w int, window_h int")
    cut = polygons.per_window(d, wins).withColumn("area", polygons.area(F.col("rings"))).collect()
    for r in cut:
        if polygons.convex(rings[r["ann_id"]][0]) and r["ann_id"] < 900:
            x, y, w = ((0, 0, 4), (2, 1, 30))[r["window_index"]]
            left = polygons.clip(rings[r["ann_id"]][0], (x, y, x + w, y + w)) - (x, y)
            assert np.array_equal(left, [(v["x"], v["y"]) for v in r["rings"][0][0]]) and r["xmax"] == left[:, 0].max()
    assert {r["ann_id"] for r in cut} >= {900} and len(cut) > 60
