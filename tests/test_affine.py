"""Composed maps against steps done one by one, and against pixels that travel with the annotations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyx.operators import affine

RINGS = "array<array<array<struct<x: double, y: double>>>>"


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame([(f"i{k}", 100 + k, 60 + k) for k in range(40)], "image_path string, width int, height int")


def points(spark, n=40):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(k, f"i{k % n}", float(x), float(y), "extra") for k, (x, y) in enumerate(rng.uniform(0, 60, (400, 2)))], "ann_id long, image_path string, x double, y double, map string")


def by_matrix(row, x, y):
    m = row["map"]
    return m["a"] * x + m["b"] * y + m["c"], m["d"] * x + m["e"] * y + m["f"]


def test_single_steps(spark, images):
    plans = lambda config: {r["image_path"]: r for r in affine.plan(images, config, 3).collect()}
    for name, place in (("HorizontalFlip", lambda w, h, x, y: (w - x, y)), ("VerticalFlip", lambda w, h, x, y: (x, h - y))):
        got = plans({name: {"p": 1}})
        assert all(by_matrix(got[f"i{k}"], 7, 9) == place(100 + k, 60 + k, 7, 9) for k in range(40))
        share = sum(r["map"]["a"] < 0 or r["map"]["e"] < 0 for r in plans(name).values()) / 40
        assert 0.2 < share < 0.8 and all(r["map"]["a"] == 1 == r["map"]["e"] for r in plans({name: {"p": 0}}).values())
    r = plans({"Resize": {"max_size": 50}})["i0"]
    assert by_matrix(r, 100, 60) == (50, 30) and (r["width"], r["height"]) == (50, 30)
    angles = set()
    for k, r in enumerate(plans({"Rotate": {"degrees": 20, "p": 1}}).values()):
        w, h = r["width"], r["height"]
        assert by_matrix(r, w / 2, h / 2) == pytest.approx((w / 2, h / 2))
        turn = math.degrees(math.atan2(-r["map"]["d"], r["map"]["a"]))
        assert -20 <= turn <= 20 and r["map"]["a"] ** 2 + r["map"]["d"] ** 2 == pytest.approx(1)
        angles.add(round(turn, 6))
    assert len(angles) == 40 and min(angles) < -5 and max(angles) > 5
    x, y = by_matrix(plans({"Rotate": {"degrees": (90, 90), "p": 1}})["i0"], 100, 30)
    assert (x, y) == pytest.approx((50, -20))  # the middle of the right side goes to the top
    seen = set()
    for r in plans({"RandomCrop": {"size": (30, 50), "p": 1}}).values():
        x, y = by_matrix(r, 0, 0)
        assert float(x).is_integer() and 0 <= -x <= 90 and 0 <= -y <= 70 and (r["content_w"], r["content_h"]) == (50, 30)
        seen.add((x, y))
    assert len(seen) > 20
    for r in plans({"RandomResizedCrop": {"size": (40, 80), "scale": (0.25, 0.5), "ratio": (0.5, 2.0), "p": 1}}).values():
        k = int(r["image_path"][1:])
        share = 80 * 40 / (r["map"]["a"] * r["map"]["e"]) / ((100 + k) * (60 + k))
        assert 0.2 < share < 0.55 and (r["width"], r["height"]) == (80, 40)
    r = plans({"PadIfNeeded": {"size": (200, 90)}})["i0"]
    assert (r["width"], r["height"], r["content_w"], r["content_h"]) == (100, 200, 100, 60) and by_matrix(r, 5, 6) == (5, 6)
    assert all(0 <= r["width"] - r["content_w"] <= 10 for r in plans({"RandomPadTo": {"p": 1}}).values())
    assert all(by_matrix(r, 3, 4) == (3, 4) for r in plans(["Blur", "GaussNoise"]).values()) and all(by_matrix(r, 3, 4) == (3, 4) for r in plans(None).values())


def test_order_and_composition(spark, images):
    """Standard steps, crops, padding, whatever the order given; one map does what the steps do one after another."""
    config = ["RandomPadTo", {"RandomCrop": {"size": (40, 40), "p": 1}}, {"Rotate": {"p": 1}}, {"Resize": {"max_size": 120}}, "HorizontalFlip"]
    whole = {r["image_path"]: r for r in affine.plan(images, config, 9).collect()}
    now, maps = images, []
    for k, step in enumerate([{"Rotate": {"p": 1}}, {"Resize": {"max_size": 120}}, {"HorizontalFlip": {}}, {"RandomCrop": {"size": (40, 40), "p": 1}}]):
        name, options = next(iter(step.items()))
        make, usual, _ = affine.STEPS[name]
        options = dict(options)
        share = options.pop("p", usual)
        m, w, h = make(lambda draw, k=k: affine.uniform(9, k, draw), F.col("width"), F.col("height"), **options)
        on = F.lit(share >= 1) | (affine.uniform(9, k, "p") < share)
        same = affine._map(1, 0, 0, 0, 1, 0)
        got = now.select("image_path", *(F.when(on, v).otherwise(s).alias(t) for t, v, s in zip(affine.TERMS, m, same, strict=True)), F.when(on, w).otherwise(F.col("width")).alias("width"), F.when(on, h).otherwise(F.col("height")).alias("height"))
        rows = {r["image_path"]: r for r in got.collect()}
        maps.append(rows)
        now = spark.createDataFrame([(p, float(r["width"]), float(r["height"])) for p, r in rows.items()], "image_path string, width double, height double")
    for path, r in whole.items():
        x, y = 11.0, 23.0
        for rows in maps:
            m = rows[path]
            x, y = m["a"] * x + m["b"] * y + m["c"], m["d"] * x + m["e"] * y + m["f"]
        assert by_matrix(r, 11.0, 23.0) == pytest.approx((x, y)) and (r["content_w"], r["content_h"]) == (40, 40) and r["width"] >= 40


def test_same_whatever_the_partitions(spark, images):
    config = ["HorizontalFlip", "Rotate", "RandomCrop"]
    one, many = (sorted(map(tuple, affine.plan(images.repartition(n), config, 5).collect())) for n in (1, 7))
    assert one == many and one != sorted(map(tuple, affine.plan(images, config, 6).collect()))


def test_geometries(spark, images):
    p = points(spark)
    config = [{"Rotate": {"degrees": (90, 90), "p": 1}}, {"RandomCrop": {"size": (50, 50), "p": 1}}]
    plans = {r["image_path"]: r for r in affine.plan(images, config, 2).collect()}
    run = affine.get_transform(config, 2)
    got = {r["ann_id"]: r for r in run(p, images).collect()}
    want = {}
    for r in p.collect():
        x, y = by_matrix(plans[r["image_path"]], r["x"], r["y"])
        if 0 <= x <= 50 and 0 <= y <= 50:
            want[r["ann_id"]] = (x, y)
    assert {k: pytest.approx((r["x"], r["y"])) for k, r in got.items()} == want and 0 < len(want) < 400 and next(iter(got.values()))["map"] == "extra"
    boxes = p.select("ann_id", "image_path", F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 9).alias("xmax"), (F.col("y") + 5).alias("ymax"))
    found = {r["ann_id"]: r for r in run(boxes, images).collect()}
    for r in boxes.collect():
        c = [by_matrix(plans[r["image_path"]], x, y) for x in (r["xmin"], r["xmax"]) for y in (r["ymin"], r["ymax"])]
        (x0, y0), (x1, y1) = (tuple(min(max(f(v[i] for v in c), 0), 50) for i in (0, 1)) for f in (min, max))
        if x1 - x0 >= 1 and y1 - y0 >= 1:
            own = found.pop(r["ann_id"])
            assert (own["xmin"], own["ymin"], own["xmax"], own["ymax"]) == pytest.approx((x0, y0, x1, y1))
    assert not found
    ring = [{"x": float(x), "y": float(y)} for x, y in ((10, 10), (40, 10), (10, 40))]
    shapes = spark.createDataFrame([(k, f"i{k}", 1.0, [[ring]]) for k in range(40)] + [(99, "unknown", 1.0, [[ring]]), (98, "i0", 1.0, None)], f"ann_id long, image_path string, xmin double, rings {RINGS}")
    for r in run(shapes, images).collect():
        expected = [by_matrix(plans[r["image_path"]], v["x"], v["y"]) for v in ring]
        assert [(v["x"], v["y"]) for v in r["rings"][0][0]] == [pytest.approx(e) for e in expected] and r["xmin"] == pytest.approx(min(e[0] for e in expected))
    assert run(p.where("false"), images).count() == 0


def test_configurations():
    assert affine.parse(["Blur", {"Rotate": {"degrees": 3}}]) == {"Blur": {}, "Rotate": {"degrees": 3}} and affine.parse("Resize") == {"Resize": {}}
    assert len(affine.available()) == 15
    for bad in ("Nope", [{"Blur": {}, "Rotate": {}}], [3], 5):
        with pytest.raises(ValueError):
            affine.parse(bad)


def test_options_that_do_not_fit(images):
    with pytest.raises(ValueError, match="Rotate"):
        affine.plan(images, {"Rotate": {"nope": 1}})
