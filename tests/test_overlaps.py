"""Questions about overlaps that are answered without their pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyx.operators import matching, overlaps, polygons, precision, runs
from canopyx.plans import registry


def _boxes(rng, n, most=60):
    low = rng.integers(0, 120, (n, 2))
    return np.c_[low, low + rng.integers(0, most, (n, 2))].astype(float)


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_counts_equal_all_pairs(few):
    rng = np.random.default_rng(5)
    for low in ((-1.0, -1.0), (50.0, 40.0)):
        for n in (1, 7, 90):
            a, b = (x[(x[:, 0] < x[:, 2]) & (x[:, 1] < x[:, 3]) & (x[:, 2:] >= low).all(axis=1)] for x in (_boxes(rng, n), _boxes(rng, 2 * n)))
            if not len(a) or not len(b):
                continue
            start, stop = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
            meet = ((start < stop) & (start >= low)).all(axis=2)
            n_found, places = overlaps.count(a, b, low, few)
            assert n_found.tolist() == meet.sum(axis=1).tolist()
            assert places.tolist() == (meet @ np.arange(len(b))).tolist()


def test_best_iou_equals_all_pairs():
    rng = np.random.default_rng(6)
    for n, most in ((1, 60), (300, 60), (900, 8)):
        a, b = (x[(x[:, 0] < x[:, 2]) & (x[:, 1] < x[:, 3])] for x in (_boxes(rng, n, most), _boxes(rng, 3 * n, most)))
        if not len(a) or not len(b):
            continue
        side = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
        inter = np.maximum(side, 0).prod(axis=2)
        area = [(x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) for x in (a, b)]
        assert overlaps.best_iou(a, b).tolist() == (inter / (area[0][:, None] + area[1] - inter)).max(axis=1).tolist()


def test_unique_pairs_and_best_overlaps_equal_those_of_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(f"i{k % 3}", k // 2, *map(int, b), k % 2 == 0) for k, b in enumerate(_boxes(rng, 160, 25))]
    rows += [("i0", 900, 5, 5, 5, 9, True), ("i1", 901, 500, 500, 700, 900, True), ("i1", 902, 520, 520, 530, 540, False), ("i1", 901, 1000, 1000, 1010, 1010, True), ("i2", 903, None, 0, 3, 3, True)]
    d = spark.createDataFrame(rows, "image_path string, ann_id long, xmin int, ymin int, xmax int, ymax int, truth boolean")
    t, p = d.where("truth"), d.where("not truth")
    pairs = matching.iou_pairs(t, p)
    order = sorted(pairs.columns)
    full = lambda x: sorted(map(str, x.select(*order).collect()))
    want = full(matching.unique_matches(pairs))
    assert len(want) > 5 and full(overlaps.unique_pairs(t, p, cell=32)) == full(overlaps.unique_pairs(t, p)) == want
    best = pairs.groupBy("image_path", "t_ann_id").agg(F.max("iou").alias("iou"))
    assert sorted(overlaps.best_overlaps(t, p, cell=32).collect()) == sorted(best.select("image_path", "t_ann_id", "iou").collect())


@pytest.mark.parametrize("name", ["metrics_long_unique", "mean_iou_by_class"])
def test_queries_make_no_pairs(spark, monkeypatch, name):
    """A crowded image has more pairs than any disk holds."""

    def none(*_):
        raise AssertionError("pairs")

    monkeypatch.setattr(matching, "iou_pairs", none)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_average_precision_pairs_the_best_detections_only(spark, monkeypatch):
    """One image with far more detections than count: pairs are made of those that do."""
    seen = []
    real = matching.iou_pairs
    monkeypatch.setattr(matching, "iou_pairs", lambda t, p, *a: seen.append(p) or real(t, p, *a))
    row = "image_path string, ann_id long, xmin int, ymin int, xmax int, ymax int, label string, score double"
    pred = spark.createDataFrame([("i", k, k, 0, k + 10, 10, "a", k / 300) for k in range(300)], row)
    truth = spark.createDataFrame([("i", k, k, 0, k + 10, 10, "a", None) for k in range(0, 300, 3)], row)
    found = precision.average_precision(truth, pred, (0.5,)).collect()
    assert seen[0].count() == precision.MOST
    assert found == precision.average_precision(truth, pred, (0.5,), pairs=real(truth, pred)).collect()


def test_masks_are_filled_by_the_batch(spark, monkeypatch):
    """Shapes of a batch don't cross to Python one by one; each has the runs that it has alone."""
    rng = np.random.default_rng(8)
    shapes = [[[[tuple(v) for v in rng.integers(-5, 30, (int(rng.integers(1, 7)), 2)).astype(float).tolist()]] for _ in range(int(rng.integers(0, 3)))] for _ in range(40)]
    for s in shapes[:10]:
        for part in s:
            part[0].append(part[0][0])  # closed
            part.append([(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)])
    rows = [(k, f"i{k % 2}", s) for k, s in enumerate(shapes)] + [(90, "i0", None), (91, "i1", [])]
    ann = spark.createDataFrame(rows, f"ann_id long, image_path string, rings {polygons.RINGS}")
    images = spark.createDataFrame([("i0", 20, 28), ("i1", 26, 18)], "image_path string, height int, width int")
    want = {k: [tuple(r) for r in runs.fill([[np.array(r) for r in part] for part in s or []], *((26, 18) if i == "i1" else (20, 28))).tolist()] for k, i, s in rows}
    monkeypatch.setattr(polygons, "_arrays", None)
    assert {r["ann_id"]: [tuple(x) for x in r["runs"]] for r in runs.masks(ann.coalesce(1), images).collect()} == want


def test_crossing_sides_of_rings_of_one_length_together():
    square, bow = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(0, 0), (4, 4), (4, 0), (0, 4)], float)
    star = np.array([(0, 3), (2, -3), (-3, 1), (3, 1), (-2, -3)], float)
    line = np.zeros((0, 2))
    assert polygons._crossing([square, bow, line, star, square[:3], bow + 9, square[::-1], star[::2]]).tolist() == [False, True, False, True, False, True, False, False]
    assert polygons._crossing([]).tolist() == []


def test_boxes_are_assigned_without_pairs(spark, monkeypatch):
    """The assignment and its pairs are those of all pairs, by image and by component, from matrices and from rows."""
    rng, rows = random.Random(8), []
    for n in range(600):
        x, y = rng.randrange(500), rng.randrange(900)
        rows.append((n, f"i{n % 3}", x, y, x + rng.randint(0, 40), y + rng.randint(0, 60), rng.choice("ab"), rng.random()))
    d = spark.createDataFrame(rows, "ann_id long, image_path string, xmin int, ymin int, xmax int, ymax int, label string, score double")
    truth, pred = d.where("ann_id % 5 < 3"), d.where("ann_id % 5 > 2")
    pairs = matching.iou_pairs(truth, pred)
    get = lambda f: sorted(map(tuple, f.collect()))
    want = get(matching.match_rows(pairs, truth, pred).na.fill(-1, ["prediction_id", "score"]).na.fill("", ["predicted_label"]))
    same, chosen = pairs.select("image_path", "t_ann_id", "p_ann_id", "inter", "iou"), get(matching.assign_pairs(pairs))
    got = overlaps.iou_rows(truth, pred)
    assert got.dtypes == same.dtypes and get(got) == get(same)

    def none(*args, **more):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(matching, "iou_pairs", none)
    monkeypatch.setattr(matching, "assign_pairs", none)
    assert get(matching.match_boxes(truth, pred).na.fill(-1, ["prediction_id", "score"]).na.fill("", ["predicted_label"])) == want
    for crowded in (overlaps.CROWDED, 0):
        assert get(overlaps.assign_boxes(truth, pred, crowded)) == chosen


def test_a_large_assignment_is_no_matrix(monkeypatch):
    """Rows of costs give what a matrix gives, more places on either side, and no more than a row is there at once."""
    rng, seen = np.random.default_rng(4), []
    far = lambda one, others: seen.append(one.ndim) or np.sqrt(((one - others) ** 2).sum(axis=-1))
    for n, m in ((40, 70), (70, 40), (1, 5), (50, 50)):
        a, b = rng.integers(0, 30, (n, 2)).astype(float), rng.integers(0, 30, (m, 2)).astype(float)
        want = sorted(matching.assign(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))))
        for limit in (matching.MATRIX, 0):
            monkeypatch.setattr(matching, "MATRIX", limit)
            assert sorted(matching.assign_places(a, b, far)) == want
            monkeypatch.undo()
    assert set(seen) == {1}


def test_paths_look_at_stretches_and_rows_may_take_none():
    """The total is that of all columns at cost 0 beyond the stretch; a row that gains nothing takes none."""
    rng = np.random.default_rng(10)
    for n, m in ((1, 1), (30, 30), (40, 15), (15, 40)):
        cost = np.zeros((n, m))
        first, last = np.sort(rng.integers(0, m + 1, (n, 2)), axis=1).T
        for i in range(n):
            cost[i, first[i] : last[i]] = -rng.integers(0, 50, last[i] - first[i])
        found = matching.assign_stretches(n, m, lambda i: (first[i], cost[i, first[i] : last[i]]), True)  # noqa: B023
        assert sum(cost[i, j] for i, j in found) == sum(cost[i, j] for i, j in matching.assign(cost))
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert all(first[i] <= j < last[i] for i, j in found)
    assert matching.assign_stretches(3, 0, lambda i: (0, np.zeros(0)), True) == []


def test_boxes_of_a_component_are_compared_with_those_near(monkeypatch):
    """A long row of boxes that overlap their neighbours: all pairs are many times those that are looked at."""
    rng = np.random.default_rng(11)
    for turn in (slice(None), [1, 0, 3, 2]):
        t, p = (np.c_[x := rng.random(300) * 3000, rng.random(300), x + rng.integers(5, 40, 300), rng.integers(2, 9, 300)][:, turn] for _ in range(2))
        seen = []
        real = matching.assign_stretches
        monkeypatch.setattr(matching, "assign_stretches", lambda n, m, look, alone: real(n, m, lambda i: (seen.append(len(look(i)[1])), look(i))[1], alone))  # noqa: B023
        found = overlaps.assign_common(t, p)
        monkeypatch.undo()
        area = overlaps._common(t[:, None], p)
        assert np.isclose(sum(area[i, j] for i, j in found), sum(area[i, j] for i, j in matching.assign(-area)))
        assert max(seen) < 30
        groups = list(overlaps._components(t, p))
        assert sum(len(i) for i, *_ in groups) == (area > 0).any(axis=1).sum() and all(area[i, j] > 0 for *_, links in groups for i, j in links)


def test_polygons_are_assigned_without_pairs(spark, monkeypatch):
    """Upright rectangles have their bounds' common areas, others what they share; pairs are no rows of a table."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(120):
        (x, y), (w, h) = rng.integers(0, 120, 2).tolist(), rng.integers(5, 40, 2).tolist()
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if k % 3 else [(x, y), (x + w, y + h // 2), (x, y + h)]
        ring = ring[::-1] if k % 4 == 0 else ring
        rows.append((k, f"i{k % 2}", [[[(float(a), float(b)) for a, b in (ring + ring[:1] if k % 5 else ring)]]], "ab"[k % 7 > 3], k / 9))
    d = spark.createDataFrame(rows, "ann_id long, image_path string, rings array<array<array<struct<x: double, y: double>>>>, label string, score double")
    truth, pred = d.where("ann_id % 4 < 2"), d.where("ann_id % 4 > 1")
    pairs = polygons.overlap_pairs(truth, pred)
    want = {(s, t): polygons.overlap(np.array(rows[s][2][0][0]), np.array(rows[t][2][0][0])) for s in range(120) for t in range(120) if s % 4 < 2 < t % 4 + 1 and s % 2 == t % 2 and t % 4 > 1}
    got = {(r["t_ann_id"], r["p_ann_id"]): r["inter"] for r in pairs.collect()}
    assert set(got) == {k for k, v in want.items() if round(v, 9) > 1e-9} and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    fill = lambda x: sorted(map(tuple, x.na.fill(-1, ["prediction_id", "score"]).na.fill("", ["predicted_label"]).collect()))
    total = lambda x: sum(got[r["truth_id"], r["prediction_id"]] for r in x.where("prediction_id is not null").collect())
    best = total(matching.match_rows(pairs, truth, pred))
    monkeypatch.setattr(matching, "assign_pairs", None)
    monkeypatch.setattr(matching, "written", None)
    found = polygons.match_polygons(truth, pred)
    assert np.isclose(total(found), best) and found.count() == truth.count()
    monkeypatch.setattr(overlaps.assign_boxes, "__defaults__", (0, *overlaps.assign_boxes.__defaults__[1:]))  # by component
    assert fill(polygons.match_polygons(truth, pred)) == fill(found)
