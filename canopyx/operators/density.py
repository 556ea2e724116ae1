"""Points as grids, and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import apply_to_both


def rasterize(points: DataFrame, rows: int, cols: int, stride: float = 1.0) -> DataFrame:
    """image_path, row, col, n: points by the nearest cell (halves to even), at the border if outside."""
    cell = lambda c, most: F.least(F.greatest(F.bround(F.col(c) / F.lit(float(stride)), 0).cast("int"), F.lit(0)), F.lit(most - 1))
    return points.groupBy("image_path", cell("y", rows).alias("row"), cell("x", cols).alias("col")).agg(F.count("*").alias("n"))


def density(points: DataFrame, rows: int, cols: int, sigma: float = 4.0, truncate: float = 4.0, distinct_cells: bool = False) -> DataFrame:
    """image_path, row, col, value: a Gaussian about each point, with values of an image summing to its points.

    Kernel offsets beyond a border reflect. distinct_cells: several points of a cell count once.
    """
    reach = int(truncate * sigma + 0.5)
    w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    kernel = [float(x) for x in w / w.sum()]
    spots = rasterize(points, rows, cols)
    spots = spots.withColumn("n", F.lit(1)) if distinct_cells else spots
    offsets = F.array(*(F.struct(F.lit(i - reach).alias("d"), F.lit(x).alias("w")) for i, x in enumerate(kernel)))
    fold = lambda c, n: F.when(c < 0, -c - 1).when(c >= n, 2 * n - 1 - c).otherwise(c)
    down = spots.select("image_path", "row", "col", "n", F.explode(offsets).alias("a")).groupBy("image_path", fold(F.col("row") + F.col("a.d"), rows).alias("row"), "col").agg(F.sum(F.col("n") * F.col("a.w")).alias("v"))
    return down.select("image_path", "row", "col", "v", F.explode(offsets).alias("b")).groupBy("image_path", "row", fold(F.col("col") + F.col("b.d"), cols).alias("col")).agg(F.sum(F.col("v") * F.col("b.w")).alias("value"))


def peaks(grid: DataFrame, threshold: float = 0.1, distance: int = 1) -> DataFrame:
    """image_path, x, y, score: cells that are no less than any within the distance and over a share of their image's maximum."""
    top = grid.groupBy("image_path").agg(F.greatest(F.max("value"), F.lit(1e-6)).alias("_top"))
    near = F.sequence(F.lit(-distance), F.lit(distance))
    spread = grid.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near))
    best = spread.groupBy("image_path", (F.col("row") + F.col("_i")).alias("row"), (F.col("col") + F.col("_j")).alias("col")).agg(F.max("value").alias("_best"))
    found = grid.join(best, ["image_path", "row", "col"]).join(top, "image_path").where((F.col("value") >= F.col("_best")) & (F.col("value") > threshold * F.col("_top")))
    return found.select("image_path", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.col("value") / F.col("_top")).alias("score"))


def sinkhorn(a: np.ndarray, b: np.ndarray, cost: np.ndarray, reg: float = 1.0, rounds: int = 100, stop: float = 1e-9) -> np.ndarray:
    """Entropic transport plan between masses a and b; a round that gives no finite number is undone and ends it."""
    k = np.exp(-cost / reg)
    u, v = np.full(len(a), 1 / max(len(a), 1)), np.full(len(b), 1 / max(len(b), 1))
    for _ in range(rounds):
        old = u, v
        v = b / (k.T @ u + 1e-16)
        u = a / (k @ v + 1e-16)
        if not (np.isfinite(u).all() and np.isfinite(v).all()):
            u, v = old
            break
        if np.abs(v * (k.T @ u) - b).sum() < stop:
            break
    return u[:, None] * k * v[None]


def transport_cost(left: DataFrame, right: DataFrame, reg: float = 1.0, rounds: int = 100) -> DataFrame:
    """image_path, cost: the transport cost between an image's points on both sides, equal masses."""

    def run(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"image_path": [key[0]], "cost": [None]})
        c = ((p[["x", "y"]].to_numpy(float)[:, None] - q[["x", "y"]].to_numpy(float)[None]) ** 2).sum(axis=2)
        c = c / max(c.max(), 1e-12)
        plan = sinkhorn(np.full(len(p), 1 / len(p)), np.full(len(q), 1 / len(q)), c, reg, rounds)
        return pd.DataFrame({"image_path": [key[0]], "cost": [float((plan * c).sum())]})

    return apply_to_both(left, right, ("image_path",), ("x", "y"), run, "image_path string, cost double")


def normalise(cells: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """cells (image_path, value) with normed, the value by its image's sum; value is rescaled to counts (image_path, count)
    where they are given. Sums join back, so an image's cells are not one task's window."""
    total = cells.groupBy("image_path").agg(F.sum("value").alias("_sum"))
    out = cells.join(total, "image_path").withColumn("normed", F.col("value") / (F.col("_sum") + 1e-4)).drop("_sum")
    if counts is None:
        return out
    out = out.join(counts.select("image_path", F.abs("count").alias("_count")), "image_path")
    return out.withColumn("value", F.col("normed") * F.greatest(F.col("_count"), F.lit(1e-4))).drop("_count")
