"""Suppression of overlapping detections, greedy by score; ties go to the smaller ann_id.

An image is dealt to grid cells, and a detection to every cell that its box (of a point: the square about it) touches, so
a large mosaic is many tasks. Of two that overlap some cell sees both. A detection inside one cell is settled there, once
all better ones that it overlaps are; one on a border waits for the votes of all its cells. Rounds repeat until all are
settled; frames smaller than a cell need one. The best unsettled detection is settled in each round, so they end.

Detections with a null coordinate stay. Repeated rows count as rows of their own. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopyx.shared import written
from canopyx.types import BOX, POINT

#: Pixels of a cell's side.
CELL = 2048
#: States and votes; of several votes the largest holds.
KEPT, OPEN, DROPPED = 0, 1, 2

Hits = Callable[[np.ndarray, int, np.ndarray], np.ndarray]


def box_hits(threshold: float) -> Hits:
    """Which of the boxes r overlap box i by an IoU over the threshold."""

    def hits(b: np.ndarray, i: int, r: np.ndarray) -> np.ndarray:
        w = np.maximum(np.minimum(b[i, 2], b[r, 2]) - np.maximum(b[i, 0], b[r, 0]), 0)
        h = np.maximum(np.minimum(b[i, 3], b[r, 3]) - np.maximum(b[i, 1], b[r, 1]), 0)
        union = (b[i, 2] - b[i, 0]) * (b[i, 3] - b[i, 1]) + (b[r, 2] - b[r, 0]) * (b[r, 3] - b[r, 1]) - w * h
        return w * h / np.where(union > 0, union, 1) > threshold

    return hits


def point_hits(radius: float) -> Hits:
    """Which of the points r are within the radius of point i."""
    return lambda p, i, r: ((p[r] - p[i]) ** 2).sum(axis=1) <= radius * radius


def vote(shape: np.ndarray, border: np.ndarray, state: np.ndarray, hits: Hits) -> np.ndarray:
    """A cell's view of its detections, in order of rank: KEPT where nothing seen here stands against it."""
    votes, beaten, waits = state.copy(), np.zeros(len(shape), bool), np.zeros(len(shape), bool)
    for i in range(len(shape)):
        settled = state[i]
        if settled == OPEN:
            votes[i] = DROPPED if beaten[i] else OPEN if waits[i] else KEPT
            settled = OPEN if votes[i] == KEPT and border[i] else votes[i]
        if settled != DROPPED:
            r = np.flatnonzero(~beaten[i + 1 :]) + i + 1
            (beaten if settled == KEPT else waits)[r[hits(shape, i, r)]] = True
    return votes


def _suppress(pred: DataFrame, by: tuple[str, ...], shape: tuple[str, ...], hits: Hits, margin: float, cell: int) -> DataFrame:
    rows = written(pred.withColumn("_row", F.monotonically_increasing_id()), "detections")
    # the first row and column of cells take what lies outside the image
    number = lambda c: F.greatest(F.floor(c / cell), F.lit(0))
    spans = [F.sequence(number(F.col(a) - margin), number(F.col(b) + margin)) for a, b in zip(shape[:2], shape[-2:], strict=True)]
    now = rows.select("_row", *by, *(F.col(c).cast("double").alias(c) for c in shape), "score", "ann_id", spans[0].alias("_xs"), spans[1].alias("_ys"))
    now = now.withColumn("_border", F.size("_xs") * F.size("_ys") > 1).withColumn("_cx", F.explode("_xs")).withColumn("_cy", F.explode("_ys")).drop("_xs", "_ys")
    now = now.withColumn("_state", F.lit(OPEN))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "ann_id", "_row"], ascending=[False, True, True], kind="stable")
        votes = vote(pdf[list(shape)].to_numpy(float), pdf["_border"].to_numpy(bool), pdf["_state"].to_numpy(np.int64), hits)
        return pd.DataFrame({"_row": pdf["_row"], "_vote": votes})[votes != KEPT]

    at, gone = (*by, "_cx", "_cy"), None
    while True:
        votes = written(now.groupBy(*at).applyInPandas(run, "_row long, _vote long"), "votes")
        out = votes.where(F.col("_vote") == DROPPED).select("_row")
        gone = out if gone is None else gone.unionByName(out)
        unsettled = votes.where(F.col("_vote") == OPEN).select("_row").distinct().join(out, "_row", "left_anti")
        if unsettled.isEmpty():
            return rows.join(gone, "_row", "left_anti").drop("_row")
        # what is dropped matters no more, nor do cells where all is settled
        left = now.drop("_state").join(out, "_row", "left_anti").join(unsettled.withColumn("_open", F.lit(OPEN)), "_row", "left").withColumn("_state", F.coalesce("_open", F.lit(KEPT))).drop("_open")
        busy = left.where(F.col("_state") == OPEN).select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(at))).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(at)]
        now = written(left.join(busy, same, "left_semi"), "unsettled")


def nms(pred: DataFrame, threshold: float = 0.15, by: tuple[str, ...] = ("image_path",), cell: int = CELL) -> DataFrame:
    """Boxes that overlap no better kept one by an IoU over the threshold."""
    return _suppress(pred, by, BOX, box_hits(threshold), 0, cell)


def nms_across_classes(pred: DataFrame, threshold: float = 0.05) -> DataFrame:
    """NMS whatever the labels, on boxes cut to whole pixels."""
    return nms(pred.withColumns({c: F.col(c).cast("int") for c in BOX}), threshold)


def suppress_points(pred: DataFrame, radius: float = 5.0, by: tuple[str, ...] = ("image_path",), cell: int = CELL) -> DataFrame:
    """Points with no better kept one within the radius; a radius of 0 or less keeps all."""
    margin = radius * (1 + 1e-9)  # more than the rounding of a difference of coordinates
    return _suppress(pred, by, POINT, point_hits(radius), margin, cell) if radius > 0 else pred


def translate(pred: DataFrame) -> DataFrame:
    """Window coordinates to image coordinates; box columns become whole numbers, cut towards zero."""
    move = {"xmin": "window_xmin", "xmax": "window_xmin", "ymin": "window_ymin", "ymax": "window_ymin"} if "xmin" in pred.columns else {"x": "window_xmin", "y": "window_ymin"}
    out = {c: F.col(c) + F.col(o) for c, o in move.items()}
    if "xmin" in out:
        out = {c: v.cast("int") for c, v in out.items()}
    return pred.withColumns(out).drop("window_xmin", "window_ymin")


def mosaic(pred: DataFrame, threshold: float | None = None, radius: float | None = None) -> DataFrame:
    """Detections of windows put together, then suppressed."""
    if threshold is None and radius is None:
        raise ValueError("neither an IoU threshold nor a radius")
    box = "xmin" in pred.columns
    if (threshold if box else radius) is None:
        raise ValueError("boxes need an IoU threshold" if box else "points need a radius")
    moved = translate(pred)
    return nms(moved, threshold) if box else suppress_points(moved, radius)


def nms_where_classes_mix(pred: DataFrame, threshold: float) -> DataFrame:
    """NMS in images with more than one label, others as they are."""
    mixed = pred.groupBy("image_path").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("image_path")
    return nms(pred.join(mixed, "image_path", "left_semi"), threshold).unionByName(pred.join(mixed, "image_path", "left_anti"))


def top_k(pred: DataFrame, k: int = 300) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("image_path").orderBy(F.desc("score"), "ann_id"))
    return pred.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
