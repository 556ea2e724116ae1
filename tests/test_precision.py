"""Average precision by ranges of areas against a plain loop over images; ids that repeat between images."""

import random

import numpy as np
import pytest

from canopyx.operators import evaluate, matching, precision, suppress

BOX = "ann_id long, image_path string, xmin double, ymin double, xmax double, ymax double, label string, score double"


def scene(seed):
    rng = random.Random(seed)
    truth, pred, k = [], [], 0
    for image in range(4):
        for _ in range(rng.randint(0, 14)):
            x, y, w, h = rng.randint(0, 200), rng.randint(0, 200), rng.choice([10, 32, 40, 96, 120]), rng.choice([10, 32, 60, 96])
            label = rng.choice("ab")
            truth.append((k, f"i{image}", x, y, x + w, y + h, label, None))
            for _ in range(rng.randint(0, 3)):
                dx, dy = rng.randint(-w // 6, w // 6), rng.randint(-h // 6, h // 6)
                pred.append((1000 + len(pred), f"i{image}", x + dx, y + dy, x + dx + w, y + dy + rng.choice([h, h, h + 5]), rng.choice([label, label, "b", "c"]), rng.randint(1, 6) / 8))
            k += 1
    return [tuple(float(v) if isinstance(v, int) and 2 <= i <= 5 else v for i, v in enumerate(r)) for r in truth], [tuple(float(v) if isinstance(v, int) and 2 <= i <= 5 else v for i, v in enumerate(r)) for r in pred]


def area(r):
    return (r[4] - r[2]) * (r[5] - r[3])


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    common = max(w, 0) * max(h, 0)
    return common / (area(a) + area(b) - common)


def plain(truth, pred, most, low, high):
    """label, threshold to ap, ar: image by image, detection by detection."""
    out = {}
    for label in sorted({t[6] for t in truth}):
        total = sum(t[6] == label and low <= area(t) <= high for t in truth)
        if not total:
            continue
        for level in precision.LEVELS:
            rows = []
            for image in {t[1] for t in truth} | {p[1] for p in pred}:
                own = sorted((t for t in truth if (t[1], t[6]) == (image, label)), key=lambda t: (not low <= area(t) <= high, t[0]))
                ranked = sorted((p for p in pred if (p[1], p[6]) == (image, label)), key=lambda p: (-p[7], p[0]))[:most]
                used = set()
                for p in ranked:
                    best, at = min(level, 1 - 1e-10), None
                    for j, t in enumerate(own):
                        if j in used or (at is not None and low <= area(own[at]) <= high and not low <= area(t) <= high) or iou(t, p) < best:
                            continue
                        best, at = iou(t, p), j
                    if at is not None:
                        used.add(at)
                    ignored = not low <= area(own[at]) <= high if at is not None else not low <= area(p) <= high
                    if not ignored:
                        rows.append((-p[7], p[0], at is not None))
            tp = np.cumsum([r[2] for r in sorted(rows)]) if rows else np.zeros(0)
            prec = np.maximum.accumulate((tp / np.arange(1, len(tp) + 1))[::-1])[::-1]
            rec = tp / total
            out[label, level] = (float(np.mean([prec[np.searchsorted(rec, x - 1e-11)] if len(rec) and rec[-1] >= x - 1e-11 else 0 for x in np.arange(101) / 100])), float(rec[-1]) if len(rec) else 0.0)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_loops(spark, seed):
    truth, pred = scene(seed)
    t, p = spark.createDataFrame(truth, BOX).repartition(3), spark.createDataFrame(pred, BOX).repartition(3)
    got = {}
    for r in precision.average_precision(t, p, most=6, areas=precision.AREAS).collect():
        got[r["area"], r["label"], r["threshold"]] = (r["ap"], r["ar"])
    want = {(name, *k): v for name, ends in precision.AREAS.items() for k, v in plain(truth, pred, 6, *ends).items()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k
    s = precision.detection_summary(t, p).first()
    mean = lambda name, ends, most, i, level=None: np.mean([v[i] for k, v in plain(truth, pred, most, *ends).items() if level in (None, k[1])])
    everything = precision.AREAS["all"]
    assert s["map"] == pytest.approx(mean("all", everything, 100, 0)) and s["map_75"] == pytest.approx(mean("all", everything, 100, 0, 0.75))
    for most in (1, 10, 100):
        assert s[f"mar_{most}"] == pytest.approx(mean("all", everything, most, 1))
    for name in ("small", "medium", "large"):
        assert s[f"map_{name}"] == pytest.approx(mean(name, precision.AREAS[name], 100, 0)) and s[f"mar_{name}"] == pytest.approx(mean(name, precision.AREAS[name], 100, 1))


def test_odd_tables(spark):
    truth, pred = scene(4)
    t, p, none = spark.createDataFrame(truth, BOX), spark.createDataFrame(pred, BOX), spark.createDataFrame([], BOX)
    assert precision.average_precision(none, p).count() == 0 and all(r["ap"] == r["ar"] == 0 for r in precision.average_precision(t, none).collect())
    s = precision.detection_summary(none, none).first()
    assert s["map"] is None and s["mar_1"] is None
    far = p.unionByName(spark.createDataFrame([(9999, "i0", 500.0, 500.0, 510.0, 510.0, "a", 1e12), (9998, "i0", 500.0, 500.0, 510.0, 510.0, "a", None), (9997, "i0", 0.0, 0.0, 9.0, 9.0, None, 0.5)], BOX))
    extra = [*pred, (9999, "i0", 500.0, 500.0, 510.0, 510.0, "a", 1e12), (9998, "i0", 500.0, 500.0, 510.0, 510.0, "a", -1.0)]
    want = plain(truth, extra, 100, *precision.AREAS["all"])
    for r in precision.average_precision(t, far).collect():
        assert (r["ap"], r["ar"]) == pytest.approx(want[r["label"], r["threshold"]], abs=1e-9)


def test_ids_of_two_images(spark):
    rows = [(1, i, x, 0.0, x + 10, 10.0, "a", 0.5) for i, x in (("p", 0.0), ("q", 100.0))]
    truth = spark.createDataFrame(rows, BOX)
    pred = spark.createDataFrame([(7, "p", 0.0, 0.0, 10.0, 10.0, "a", 0.5), (7, "q", 105.0, 0.0, 115.0, 10.0, "a", 0.5)], BOX)
    pairs = matching.iou_pairs(truth, pred)
    assert evaluate.mean_iou(pairs, truth).first()[0] == pytest.approx((1 + 1 / 3) / 2)
    assert [tuple(r) for r in evaluate.mean_iou_by_class(pairs, truth).collect()] == [("a", pytest.approx(2 / 3))]
    assert matching.unique_matches(pairs).count() == 2
    got = matching.with_truth(matching.match_boxes(truth, pred), truth).collect()
    assert len(got) == 2 and {(r["image_path"], r["xmin"]) for r in got} == {("p", 0.0), ("q", 100.0)}


def test_mosaic_arguments(spark):
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 0, 0)], "xmin double, ymin double, xmax double, ymax double, window_xmin int, window_ymin int")
    for d, options in ((boxes, {"radius": 3.0}), (boxes.selectExpr("xmin as x", "ymin as y", "window_xmin", "window_ymin"), {"threshold": 0.5}), (boxes, {})):
        with pytest.raises(ValueError):
            suppress.mosaic(d, **options)
