"""Average precision and recall of detections, with areas that count and areas that are ignored.

Detections of an image and label, best score first, each take the free truth of greatest overlap that reaches the threshold:
one within the range of areas if there is one, else one outside, which makes the detection ignored. A detection without truth
counts as wrong if its own area is in the range. Only pairs that overlap enough pass through Python, all ranges and thresholds
at once; whatever pairs are given (boxes, polygons, masks) the rest is the same.

Running sums down the scores go over ranges of a sort first (a written table, cut by sampled scores, so no label's detections
are one window however they are spread) and then within each. Ties in score go by id, ties in overlap to the greater id.
Detections and truth with a null label take no part; a null score ranks last. Rows of one id in an image count as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyx.functions import boxes
from canopyx.shared import written

from . import matching

LEVELS = tuple(np.round(np.arange(0.5, 1.0, 0.05), 2).tolist())
#: Fixed values of the metric: ranges of areas in pixels, ends included.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
MOST = 100


def _with_area(d: DataFrame) -> DataFrame:
    area = F.col("area") if "area" in d.columns else boxes.area(boxes.box())
    return d.where("label is not null").select("image_path", "ann_id", "label", *(["score"] if "score" in d.columns else []), area.cast("double").alias("area")).dropDuplicates(["image_path", "ann_id"])


def ranked(pred: DataFrame, most: int = MOST) -> DataFrame:
    """The `most` best detections of each image and label, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("image_path", "label").orderBy(F.desc_nulls_last("score"), "ann_id"))
    return pred.withColumn("rank", rank).where(F.col("rank") <= most)


def in_ranks(pred: DataFrame, most: int = MOST) -> DataFrame:
    """Rows of pred that matches() looks at, so that pairs need be made of those only: a crowded image has that many times its truth."""
    return pred.join(ranked(_with_area(pred), most).select("image_path", "ann_id"), ["image_path", "ann_id"], "left_semi")


def matches(pairs: DataFrame, truth: DataFrame, pred: DataFrame, thresholds: tuple[float, ...] = LEVELS, areas: dict[str, tuple[float, float]] = AREAS, most: int = MOST) -> DataFrame:
    """image_path, label, ann_id, score, rank, tp and counts of the best detections: for each range and threshold, in this order,
    whether the detection is right, and whether it counts at all.

    pairs: image_path, t_ann_id, p_ann_id, iou. truth and pred: image_path, ann_id, label, and area, else a box.
    """
    ranges = np.array(list(areas.values()), float)
    level = np.minimum(np.array(thresholds, float), 1 - 1e-10)
    n = len(ranges) * len(level)
    best = ranked(_with_area(pred), most)
    t = _with_area(truth).select("image_path", "label", F.col("ann_id").alias("t_ann_id"), F.col("area").alias("t_area"))
    p = best.select("image_path", "label", F.col("ann_id").alias("p_ann_id"), "rank")
    near = pairs.where(F.col("iou") >= float(level.min())).select("image_path", "t_ann_id", "p_ann_id", F.col("iou").cast("double").alias("iou"))
    near = near.join(p, ["image_path", "p_ann_id"]).join(t, ["image_path", "t_ann_id", "label"])

    def greedy(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "t_ann_id"])
        names, which = np.unique(frame["t_ann_id"].to_numpy(), return_inverse=True)
        area = np.zeros(len(names))
        area[which] = frame["t_area"].to_numpy(float)
        counts = (area >= ranges[:, :1]) & (area <= ranges[:, 1:])  # ranges x truth
        free = np.ones((len(ranges), len(level), len(names)), bool)
        cuts = np.flatnonzero(np.r_[True, np.diff(frame["rank"].to_numpy()) > 0, True])
        ids, overlap, out = frame["p_ann_id"].to_numpy(), frame["iou"].to_numpy(float), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, v = which[a:b], overlap[a:b]
            able = free[:, :, own] & (v >= level[:, None])
            # of equals the last: places are counted from the end
            pick = [b - a - 1 - np.where(ok, v, -1.0)[:, :, ::-1].argmax(axis=2) for ok in (able & counts[:, None, own], able & ~counts[:, None, own])]
            right, ignored = (np.take_along_axis(ok, place[:, :, None], 2)[:, :, 0] for ok, place in zip((able & counts[:, None, own], able & ~counts[:, None, own]), pick, strict=True))
            ignored &= ~right
            taken = own[np.where(right, pick[0], pick[1])]
            r, h = np.nonzero(right | ignored)
            free[r, h, taken[r, h]] = False
            out.append((ids[a], right.ravel().tolist(), ignored.ravel().tolist()))
        return pd.DataFrame(out, columns=["ann_id", "right", "ignored"]).assign(image_path=key[0], label=key[1])[["image_path", "label", "ann_id", "right", "ignored"]]

    found = near.select("image_path", "label", "t_ann_id", "p_ann_id", "iou", "rank", "t_area").groupBy("image_path", "label").applyInPandas(greedy, "image_path string, label string, ann_id long, right array<boolean>, ignored array<boolean>")
    inside = [F.col("area").between(float(lo), float(hi)) for lo, hi in ranges for _ in level]
    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(False))
    flags = best.join(found, ["image_path", "label", "ann_id"], "left")
    return flags.select("image_path", "label", "ann_id", "score", "rank", F.array(*(at("right", i).cast("int") for i in range(n))).alias("tp"), F.array(*((at("right", i) | (~at("ignored", i) & inside[i])).cast("int") for i in range(n))).alias("counts"))


def _totals(truth: DataFrame, areas: dict[str, tuple[float, float]]) -> DataFrame:
    """label, area and n: truth rows in each range."""
    each = F.array(*(F.struct(F.lit(name).alias("area"), F.col("area").between(float(lo), float(hi)).cast("int").alias("n")) for name, (lo, hi) in areas.items()))
    return _with_area(truth).select("label", F.explode(each).alias("a")).groupBy("label", F.col("a.area").alias("area")).agg(F.sum("a.n").alias("n"))


def curves(found: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = LEVELS, areas: dict[str, tuple[float, float]] = AREAS) -> DataFrame:
    """label, area, threshold, ap (101-point interpolated precision) and ar (the recall reached) of matches(); 0 where nothing is
    found, and no row for a range without truth."""
    names = [(a, float(t)) for a in areas for t in thresholds]
    order = [F.desc_nulls_last("score"), F.col("ann_id"), F.col("image_path")]
    rows = written(found.repartitionByRange("label", *order).withColumn("_part", F.spark_partition_id()), "hits")
    both = [(kind, i, F.get(kind, F.lit(i))) for kind in ("tp", "counts") for i in range(len(names))]
    sums = rows.groupBy("label", "_part").agg(*(F.sum(v).alias(f"_{kind}{i}") for kind, i, v in both))
    ahead = Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the sort
    before = sums.select("label", "_part", *(F.coalesce(F.sum(f"_{kind}{i}").over(ahead), F.lit(0)).alias(f"_{kind}{i}") for kind, i, _ in both))
    own = Window.partitionBy("label", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select("label", "_part", "tp", *(F.sum(v).over(own).alias(f"_own_{kind}{i}") for kind, i, v in both)).join(before, ["label", "_part"])
    # precision is highest where a right detection comes in, so only those speak
    point = lambda i: F.when(F.get("tp", F.lit(i)) == 1, F.struct(F.lit(i).alias("k"), (F.col(f"_own_tp{i}") + F.col(f"_tp{i}")).alias("tp"), (F.col(f"_own_counts{i}") + F.col(f"_counts{i}")).alias("n")))
    points = running.select("label", F.explode(F.array_compact(F.array(*map(point, range(len(names)))))).alias("c")).select("label", "c.*")
    table = F.array(*(F.struct(F.lit(a).alias("area"), F.lit(t).alias("threshold")) for a, t in names))
    named = points.select("label", F.get(table, F.col("k")).alias("c"), "tp", "n").select("label", "c.*", "tp", F.col("n").alias("seen"))
    total = _totals(truth, areas).where("n > 0")
    curve = named.join(total, ["label", "area"]).select("label", "area", "threshold", (F.col("tp") / F.col("n")).alias("r"), (F.col("tp") / F.col("seen")).alias("p"))
    # each point speaks for the highest recall level that it reaches; levels below take the best from there on
    top = curve.groupBy("label", "area", "threshold", F.floor(F.col("r") * 100 + 1e-9).cast("int").alias("level")).agg(F.max("p").alias("p"), F.max("r").alias("r"))
    grid = top.select("label", "area", "threshold", "p", F.explode(F.sequence(F.lit(0), "level")).alias("level")).groupBy("label", "area", "threshold", "level").agg(F.max("p").alias("p"))
    ends = grid.groupBy("label", "area", "threshold").agg((F.sum("p") / 101).alias("ap")).join(top.groupBy("label", "area", "threshold").agg(F.max("r").alias("ar")), ["label", "area", "threshold"])
    every = total.select("label", "area", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    return every.join(ends, ["label", "area", "threshold"], "left").na.fill(0.0, ["ap", "ar"])


def _box_pairs(truth: DataFrame, pred: DataFrame, most: int = MOST) -> DataFrame:
    side = lambda d: d.select("image_path", "ann_id", "xmin", "ymin", "xmax", "ymax")
    return matching.iou_pairs(side(truth), side(in_ranks(pred, most))).select("image_path", "t_ann_id", "p_ann_id", "iou")


def average_precision(truth: DataFrame, pred: DataFrame, thresholds: tuple[float, ...] = LEVELS, most: int = MOST, areas: dict[str, tuple[float, float]] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """label, threshold, ap and ar for every label of the truth and every threshold, of boxes or of given pairs; with areas, for
    each of them too (column area)."""
    ranges = areas or {"all": AREAS["all"]}
    found = matches(_box_pairs(truth, pred, most) if pairs is None else pairs, truth, pred, thresholds, ranges, most)
    out = curves(found, truth, thresholds, ranges)
    return out if areas else out.drop("area")


def detection_summary(truth: DataFrame, pred: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """map, map_50, map_75, map_<range>, mar_1, mar_10, mar_100 and mar_<range> over the labels with truth in the range; null
    for a range without any. One run of the matching serves all: the first detections of a run are those of a shorter one."""
    found = written(matches(_box_pairs(truth, pred) if pairs is None else pairs, truth, pred), "matches")
    c = written(curves(found, truth), "curves")
    over = lambda what, which: F.avg(F.when(which, F.col(what)))
    every = F.col("area") == "all"
    at = lambda t: every & (F.abs(F.col("threshold") - t) < 1e-9)
    sized = [over(f"a{k}", F.col("area") == a).alias(f"ma{k}_{a}") for k in "pr" for a in AREAS if a != "all"]
    out = c.agg(over("ap", every).alias("map"), over("ap", at(0.5)).alias("map_50"), over("ap", at(0.75)).alias("map_75"), over("ar", every).alias("mar_100"), *sized)
    hits: Column = F.aggregate(F.slice("tp", 1, len(LEVELS)), F.lit(0), lambda a, x: a + x)  # of the first range, all
    few = found.groupBy("label").agg(*(F.sum(F.when(F.col("rank") <= k, hits).otherwise(0)).alias(f"_{k}") for k in (1, 10)))
    n = _totals(truth, {"all": AREAS["all"]}).where("n > 0").join(few, "label", "left")
    short = n.agg(*(F.avg(F.coalesce(F.col(f"_{k}"), F.lit(0)) / (F.col("n") * len(LEVELS))).alias(f"mar_{k}") for k in (1, 10)))
    return out.crossJoin(short)  # one row each
