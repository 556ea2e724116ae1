"""Model scoring as a plug-in: windows in, detections out, in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyx.functions import boxes
from canopyx.operators import evaluate, suppress, tiling, validate

DETECTIONS = "image_path string, window_index int, window_xmin int, window_ymin int, xmin double, ymin double, xmax double, ymax double, label string, score double, ann_id long"
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_windows(windows: DataFrame, scorer: Scorer) -> DataFrame:
    """scorer gets a batch of windows and returns the columns of DETECTIONS, in window coordinates."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = scorer(frame)
            missing = {"image_path", "xmin", "ymin", "xmax", "ymax", "label", "score"}.difference(found.columns)
            if missing:
                raise ValueError(f"the scorer's result lacks {sorted(missing)}")
            yield found

    return windows.mapInPandas(run, DETECTIONS)


def _decoded(found: DataFrame, labels: dict | None) -> DataFrame:
    return found if labels is None else found.withColumn("label", boxes.decode_label(F.col("label"), {str(k): v for k, v in labels.items()}))


def _whole(images: DataFrame) -> DataFrame:
    """Each image as one window."""
    return images.select("image_path", F.lit(0).alias("window_index"), F.lit(0).alias("window_xmin"), F.lit(0).alias("window_ymin"), F.col("width").alias("window_w"), F.col("height").alias("window_h"))


def predict_image(images: DataFrame, scorer: Scorer, labels: dict | None = None, threshold: float = 0.05) -> DataFrame:
    """Detections of whole images, suppressed whatever their classes, labels decoded."""
    return _decoded(suppress.nms_across_classes(score_windows(_whole(images), scorer).drop("window_index", "window_xmin", "window_ymin"), threshold), labels)


def predict_file(images: DataFrame, scorer: Scorer, labels: dict | None = None, threshold: float = 0.05) -> DataFrame:
    """Detections of whole images, suppressed where an image has more than one class, labels decoded."""
    return _decoded(suppress.nms_where_classes_mix(score_windows(_whole(images), scorer).drop("window_index", "window_xmin", "window_ymin"), threshold), labels)


def predict_tile(images: DataFrame, scorer: Scorer, patch: int = 400, overlap: float = 0.05, threshold: float = 0.15, labels: dict | None = None, crop_models: tuple = ()) -> DataFrame:
    """Windows, scores, and one mosaic for each image, labels decoded. crop_models: functions from a batch of detections to
    (ann_id, label, score); degenerate boxes get no crop."""
    found = _decoded(suppress.mosaic(score_windows(tiling.windows(images, patch, overlap), scorer), threshold=threshold), labels)
    results = [validate.drop_degenerate(found).mapInPandas(lambda frames, m=m: (m(f)[["ann_id", "label", "score"]] for f in frames), "ann_id long, label string, score double") for m in crop_models]
    return evaluate.attach_crop_results(found, *results) if results else found
