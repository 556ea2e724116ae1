"""Spatial joins and one-to-one matching of predictions to truth."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyx.functions import boxes
from canopyx.graph import components
from canopyx.shared import written
from canopyx.types import BOX

CELL = 128


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col("image_path"), *(F.col(c).alias(prefix + c) for c in df.columns if c != "image_path"))


def _in_cells(df: DataFrame, prefix: str, cell: int) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(prefix + lo) / cell), F.floor(F.col(prefix + hi) / cell))
    return df.withColumn("_cx", F.explode(span("xmin", "xmax"))).withColumn("_cy", F.explode(span("ymin", "ymax")))


def iou_pairs(truth: DataFrame, pred: DataFrame, cell: int = CELL) -> DataFrame:
    """Truth and prediction boxes of an image that overlap: t_ and p_ columns, inter, iou.

    Both sides are dealt to grid cells, so a crowded image is many keys; a pair counts in the cell that holds the larger
    of the lower corners only.
    """
    t, p = _in_cells(_prefixed(truth, "t_"), "t_", cell), _in_cells(_prefixed(pred, "p_"), "p_", cell)
    both = t.join(p, ["image_path", "_cx", "_cy"])
    own = (F.col("_cx") == F.floor(F.greatest("t_xmin", "p_xmin") / cell)) & (F.col("_cy") == F.floor(F.greatest("t_ymin", "p_ymin") / cell))
    a, b = boxes.box("t_"), boxes.box("p_")
    both = both.where(own).withColumn("inter", boxes.intersection(a, b)).where("inter > 0")
    return both.withColumn("iou", boxes.iou(a, b)).drop("_cx", "_cy")


def points_in_boxes(points: DataFrame, truth: DataFrame, cell: int = CELL) -> DataFrame:
    """Each point with each box it lies strictly inside of (t_ columns); points in none keep a row.

    A point has one grid cell and a box all that it touches, so the join's keys are cells and the left side stays whole. Boxes of
    images without points go before they are dealt to cells.
    """
    known = truth.join(points.select("image_path").distinct(), "image_path", "left_semi")
    t = _in_cells(_prefixed(known, "t_").withColumnRenamed("image_path", "_image"), "t_", cell)
    inside = (F.col("x") > F.col("t_xmin")) & (F.col("x") < F.col("t_xmax")) & (F.col("y") > F.col("t_ymin")) & (F.col("y") < F.col("t_ymax"))
    p = points.withColumns({"_px": F.floor(F.col("x") / cell), "_py": F.floor(F.col("y") / cell)})
    same = (F.col("image_path") == F.col("_image")) & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))
    return p.join(t, same & inside, "left").drop("_image", "_px", "_py", "_cx", "_cy")


def unique_matches(pairs: DataFrame) -> DataFrame:
    """Pairs whose truth and prediction overlap nothing else: the assignment is theirs whatever the rest is."""
    alone = lambda c: pairs.groupBy("image_path", c).agg(F.count("*").alias("_n")).where("_n = 1").select("image_path", c)
    return pairs.join(alone("t_ann_id"), ["image_path", "t_ann_id"], "left_semi").join(alone("p_ann_id"), ["image_path", "p_ann_id"], "left_semi")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, min(rows, columns) of them, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        return [(r, c) for c, r in assign(cost.T)]
    return assign_rows(*cost.shape, cost.__getitem__)


def assign_rows(n: int, m: int, row: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """assign() of n rows, m at most, of which row(i) tells the costs."""
    return assign_stretches(n, m, lambda i: (0, row(i)))


def assign_stretches(n: int, m: int, look: Callable[[int], tuple[int, np.ndarray]], alone: bool = False) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost. look(i) gives the first column that row i may take and the costs from there on;
    with `alone` a row may also take none, at cost 0, else each has to take one.

    Prices of columns are 0 or under, and 0 where a column is free. A path looks at rows in the order of their distance and
    changes prices at its end only, so a row that is looked at costs a few passes over its own stretch.
    """
    price, paid, owner, mate = np.zeros(m), np.zeros(m), np.full(m, -1), np.full(n, -1)
    for i in range(n):
        at, cost = look(i)
        far, came, cut = np.full(m, np.inf), np.full(m, i), price.copy()
        far[at : at + len(cost)] = cost - price[at : at + len(cost)]
        seen, reach, left, last = [], [], 0.0 if alone else np.inf, i
        while True:
            j = int(far.argmin()) if m else -1
            end = far[j] if m else np.inf
            if left <= end or owner[j] < 0:
                break
            seen.append(j)
            reach.append(end)
            far[j], cut[j] = np.inf, -np.inf  # a column that was seen is never nearer
            r = int(owner[j])
            at, cost = look(r)
            base = paid[j] - price[j] - end
            own = slice(at, at + len(cost))
            now = cost - cut[own]
            now -= base
            better = now < far[own]
            np.copyto(far[own], now, where=better)
            came[own][better] = r
            if alone and -base < left:
                left, last = -base, r
        if left <= end:  # the row at the path's end takes none
            end, j = left, int(mate[last])
            mate[last] = -1
        if seen:
            price[seen] += np.array(reach) - end
        while j >= 0:
            r = int(came[j])
            at, cost = look(r)
            owner[j], paid[j], mate[r], j = r, cost[j - at], j, int(mate[r])
    return [(i, int(j)) for i, j in enumerate(mate) if j >= 0]


#: Costs that a task keeps as a matrix (320 MB); of more it works out a row whenever it is looked at.
MATRIX = 40_000_000


def assign_places(a: np.ndarray, b: np.ndarray, cost: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """assign() of places of a and b; cost(x, others) is that of one place with each of the others, the same from either side."""
    if len(a) > len(b):
        return [(r, c) for c, r in assign_places(b, a, cost)]
    if len(a) * len(b) > MATRIX:
        return assign_rows(len(a), len(b), lambda k: cost(a[k], b))
    whole = np.array([cost(x, b) for x in a], float).reshape(len(a), len(b))
    return assign_rows(*whole.shape, whole.__getitem__)


def apply_to_both(left: DataFrame, right: DataFrame, by: tuple[str, ...], columns: tuple[str, ...], f, schema: str) -> DataFrame:
    """f(key, left rows, right rows) for each key on either side: one shuffle of the two sides' union."""
    side = lambda d, name: d.select(*by, *columns, F.lit(name).alias("_left"))
    rows = side(left, True).unionByName(side(right, False))

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        return f(key, *(frame[frame["_left"] == s].drop(columns="_left").reset_index(drop=True) for s in (True, False)))

    return rows.groupBy(*by).applyInPandas(run, schema)


_POINT_COLUMNS = ("ann_id", "x", "y", "label", "score")


def _groups(links: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Links by connected component."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in links:
        up[root(("t", i))] = root(("p", j))
    out: dict = {}
    for i, j in links:
        out.setdefault(root(("t", i)), []).append((i, j))
    return list(out.values())


#: Overlaps of an image that one task may assign; in more crowded ones each component of overlapping boxes is a group.
CROWDED = 1_000_000


def assign_pairs(pairs: DataFrame, weight: str = "inter", crowded: int = CROWDED) -> DataFrame:
    """Of pairs (image_path, t_ann_id, p_ann_id, weight), those of the one-to-one assignment of greatest total weight.

    The problem falls into components of pairs. Groups are images, or components where an image is crowded; the result is
    the same. Equal totals are settled by ids.
    """
    pairs = written(pairs.where(F.col(weight) > 0).select("image_path", "t_ann_id", "p_ann_id", F.col(weight).cast("double").alias("_w")), "pairs")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t_ann_id", "p_ann_id"])
        image, value = frame["image_path"].iloc[0], {(t, p): w for t, p, w in frame[["t_ann_id", "p_ann_id", "_w"]].itertuples(index=False)}
        out = []
        for links in _groups(list(value)):
            rows, cols = sorted({i for i, _ in links}), sorted({j for _, j in links})
            area = np.zeros((len(rows), len(cols)))
            at_row, at_col = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
            for t, q in links:
                area[at_row[t], at_col[q]] = value[t, q]
            out += [(image, rows[r], cols[c]) for r, c in assign(-area) if area[r, c] > 0]
        return pd.DataFrame(out, columns=["image_path", "t_ann_id", "p_ann_id"])

    schema = "image_path string, t_ann_id long, p_ann_id long"
    most = pairs.groupBy("image_path").count().agg(F.max("count")).first()[0] or 0
    if most <= crowded:
        return pairs.groupBy("image_path").applyInPandas(run, schema)
    node = lambda side: F.xxhash64(F.lit(side), "image_path", f"{side}_ann_id")
    named = pairs.withColumns({"_t": node("t"), "_p": node("p")})
    roots = components(named.select(F.col("_t").alias("a"), F.col("_p").alias("b")))
    whole = named.join(roots, F.col("_t") == F.col("node"), "left").withColumn("_group", F.coalesce("root", "_t"))
    return whole.select("_group", "image_path", "t_ann_id", "p_ann_id", "_w").groupBy("_group").applyInPandas(run, schema)


_MATCH_COLUMNS = ["image_path", "truth_id", "prediction_id", "IoU", "score", "predicted_label", "true_label"]
_POINT_MATCH = "image_path string, truth_id long, prediction_id long, distance double, score double, predicted_label string, true_label string"


def match_rows(pairs: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """A row for each truth row, with its partner under assign_pairs(pairs) and their IoU; null and 0 without one."""
    pairs = written(pairs.select("image_path", "t_ann_id", "p_ann_id", "inter", "iou"), "overlaps")
    return _partners(assign_pairs(pairs).join(pairs.drop("inter"), ["image_path", "t_ann_id", "p_ann_id"]), truth, pred, F.col("iou"))


def _partners(chosen: DataFrame, truth: DataFrame, pred: DataFrame, iou, columns: tuple[str, ...] = ()) -> DataFrame:
    """A row for each truth row; iou tells of chosen pairs, with `columns` of both (t_ and p_)."""
    chosen = chosen.join(pred.select("image_path", F.col("ann_id").alias("p_ann_id"), "score", F.col("label").alias("predicted_label"), *(F.col(c).alias(f"p_{c}") for c in columns)), ["image_path", "p_ann_id"])
    rows = truth.select("image_path", F.col("ann_id").alias("t_ann_id"), F.col("label").alias("true_label"), *(F.col(c).alias(f"t_{c}") for c in columns)).join(chosen, ["image_path", "t_ann_id"], "left")
    return rows.select("image_path", F.col("t_ann_id").alias("truth_id"), F.col("p_ann_id").alias("prediction_id"), F.coalesce(iou, F.lit(0.0)).alias("IoU"), "score", "predicted_label", "true_label")


def match_boxes(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """A row for each truth box, with the prediction that the assignment of greatest total common area gives it. A partner
    that shares no area is none. Pairs of boxes are never rows: a task works out the areas it looks at."""
    from . import overlaps

    return _partners(overlaps.assign_boxes(truth, pred), truth, pred, boxes.iou(boxes.box("t_"), boxes.box("p_")), BOX)


def with_truth(rows: DataFrame, truth: DataFrame, columns: tuple[str, ...] = BOX) -> DataFrame:
    """Matched rows with columns of their truth rows; ids are an image's own."""
    return rows.join(truth.select("image_path", F.col("ann_id").alias("truth_id"), *columns), ["image_path", "truth_id"], "left")


def match_points(truth: DataFrame, pred: DataFrame, norm: int = 2) -> DataFrame:
    """A row for each truth point, with the prediction of the assignment of least total distance; without one the distance is infinite."""

    def run(key, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame(columns=[*_MATCH_COLUMNS[:3], "distance", *_MATCH_COLUMNS[4:]])
        t, p = (x.sort_values("ann_id").reset_index(drop=True) for x in (t, p))
        a, b = (s[["x", "y"]].to_numpy(float) for s in (t, p))
        far = lambda one, others: np.abs(one - others).sum(axis=-1) if norm == 1 else np.sqrt(((one - others) ** 2).sum(axis=-1))
        partner = dict(assign_places(a, b, far)) if len(t) and len(p) else {}
        pick = lambda c: [p[c].iloc[partner[i]] if i in partner else None for i in range(len(t))]
        return pd.DataFrame({"image_path": key[0], "truth_id": t["ann_id"], "prediction_id": pd.Series([None if i is None else int(i) for i in pick("ann_id")], dtype=object), "distance": [float(far(a[i], b[partner[i]])) if i in partner else np.inf for i in range(len(t))], "score": pick("score"), "predicted_label": pick("label"), "true_label": t["label"].tolist()})

    return apply_to_both(truth, pred, ("image_path",), _POINT_COLUMNS, run, _POINT_MATCH)


def match_predictions(pred: DataFrame, truth: DataFrame, task: str) -> DataFrame:
    if task == "box":
        return match_boxes(truth, pred)
    if task == "point":
        return match_points(truth, pred)
    if task == "polygon":
        from . import polygons

        return polygons.match_polygons(truth, pred)
    raise ValueError(f"no matching for {task}")
