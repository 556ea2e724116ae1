"""Metrics of matched predictions. Undefined ratios are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyx.shared import written

from . import matching, validate

IOU_THRESHOLD, DISTANCE_THRESHOLD = 0.4, 10.0


def image_recall_precision(truth: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """For each image with truth: n_truth, n_pred, n_match, recall, precision. matched: a row for each true positive."""
    count = lambda d, name: d.groupBy("image_path").agg(F.count("*").alias(name))
    out = count(truth, "n_truth").join(count(pred, "n_pred"), "image_path", "left").join(count(matched, "n_match"), "image_path", "left").na.fill(0, ["n_pred", "n_match"])
    return out.withColumn("recall", F.col("n_match") / F.col("n_truth")).withColumn("precision", F.when(F.col("n_pred") > 0, F.col("n_match") / F.col("n_pred")))


def macro(per_image: DataFrame) -> DataFrame:
    return per_image.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))


def class_metrics(matched: DataFrame) -> DataFrame:
    """matched (true_label, predicted_label): label, recall, precision, size for every label on either side."""
    m = matched.where("predicted_label is not null").withColumn("_hit", (F.col("true_label") == F.col("predicted_label")).cast("long"))
    t = m.groupBy(F.col("true_label").alias("label")).agg(F.sum("_hit").alias("_t"), F.count("*").alias("size"))
    p = m.groupBy(F.col("predicted_label").alias("label")).agg(F.sum("_hit").alias("_p"), F.count("*").alias("_np"))
    out = t.join(p, "label", "full")
    zero = F.lit(0.0)
    return out.select("label", F.coalesce(F.col("_t") / F.col("size"), zero).alias("recall"), F.coalesce(F.col("_p") / F.col("_np"), zero).alias("precision"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def evaluate(pred: DataFrame, truth: DataFrame, task: str = "box", iou_threshold: float = IOU_THRESHOLD, distance_threshold: float = DISTANCE_THRESHOLD) -> dict:
    """Matches, per-image ratios, macro means and class metrics of predictions against truth; truth without its empty frames.

    Without predictions the recall is 0 and the precision null; without truth the recall is null and the precision 0.
    """
    truth = validate.drop_empty(truth)
    rows = matching.match_predictions(pred, truth, task)
    rows = written(rows.withColumn("match", F.col("distance") < distance_threshold if task == "point" else F.col("IoU") > iou_threshold), "matches")
    per_image = image_recall_precision(truth, pred, rows.where("match"))
    sides = pred.limit(1).select(F.lit(1).alias("_p")).unionByName(truth.limit(1).select(F.lit(1).alias("_t")), allowMissingColumns=True).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    means = macro(per_image).crossJoin(sides)  # one row each
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    means = means.select(
        F.when(F.col("_p").isNull(), zero).when(F.col("_t").isNull(), none).otherwise(F.col("recall")).alias("recall"),
        F.when(F.col("_p").isNull(), none).when(F.col("_t").isNull(), zero).otherwise(F.col("precision")).alias("precision"),
    )
    return {"results": rows, "per_image": per_image, "macro": means, "class": class_metrics(rows.where("match")).orderBy("label")}


COUNTERS = ("n_images", "recall_sum", "recall_images", "precision_sum", "precision_images", "empty_images", "empty_correct")


def counters(per_image: DataFrame, empty: DataFrame, pred: DataFrame) -> DataFrame:
    """Sums that add up over batches. per_image: of images with truth; empty: image_path of frames without objects.

    An empty frame with predictions counts as precision 0, one without is correct; neither counts for recall.
    """
    frames = empty.select("image_path").distinct().join(pred.select("image_path", F.lit(1).alias("_p")).distinct(), "image_path", "left")
    rows = per_image.select("recall", "precision", F.lit(0).alias("_e"), F.lit(0).alias("_c")).unionByName(frames.select(F.lit(None).cast("double").alias("recall"), F.when(F.col("_p").isNotNull(), 0.0).alias("precision"), F.lit(1).alias("_e"), F.when(F.col("_p").isNull(), 1).otherwise(0).alias("_c")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(F.count("*").alias("n_images"), F.coalesce(F.sum("recall"), F.lit(0.0)).alias("recall_sum"), F.count("recall").alias("recall_images"), F.coalesce(F.sum("precision"), F.lit(0.0)).alias("precision_sum"), F.count("precision").alias("precision_images"), total("_e").alias("empty_images"), total("_c").alias("empty_correct"))


def from_counters(sums: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.select(ratio("recall_sum", "recall_images").alias("box_recall"), ratio("precision_sum", "precision_images").alias("box_precision"), ratio("empty_correct", "empty_images").alias("empty_frame_accuracy"))


def score_stats(pred: DataFrame, truth: DataFrame) -> DataFrame:
    s = pred.groupBy("image_path").agg(F.count("*").alias("pred_count"), F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.stddev_samp("score").alias("std"))
    return s.join(truth.groupBy("image_path").agg(F.count("*").alias("gt_count")), "image_path", "full").na.fill(0, ["pred_count", "gt_count"])


def count_mae(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return score_stats(pred, truth).agg(F.avg(F.abs(F.col("pred_count") - F.col("gt_count"))).alias("count_mae"))


def count_log_mae(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """As count_mae, of the logarithms of one more than the counts."""
    return score_stats(pred, truth).agg(F.avg(F.abs(F.log1p("pred_count") - F.log1p("gt_count"))).alias("count_log_mae"))


def mean_iou(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean over truth boxes of their best IoU, 0 without any."""
    return _best_overlap(pairs, truth).agg(F.avg("iou").alias("iou"))


def mean_iou_by_class(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """label and the mean over its truth boxes of their best IoU."""
    return _best_overlap(pairs, truth).groupBy("label").agg(F.avg("iou").alias("iou"))


def _best_overlap(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """label and best IoU of each truth box; empty frames have none."""
    best = pairs.groupBy("image_path", F.col("t_ann_id").alias("ann_id")).agg(F.max("iou").alias("iou"))
    return validate.drop_empty(truth).join(best, ["image_path", "ann_id"], "left").select("label", F.coalesce("iou", F.lit(0.0)).alias("iou"))


def class_accuracy(labelled: DataFrame) -> DataFrame:
    """labelled (true_label, predicted_label): accuracy by class; label_metrics() has it over all."""
    hit = (F.col("true_label") == F.col("predicted_label")).cast("int")
    return labelled.groupBy("true_label").agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def label_metrics(labelled: DataFrame) -> DataFrame:
    """accuracy_micro, precision_micro and precision_macro of labelled (true_label, predicted_label). A label that is never
    predicted has precision 0; the macro mean is over labels on either side."""
    hit = (F.col("true_label") == F.col("predicted_label")).cast("int")
    pairs = labelled.groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"), F.sum(hit).alias("h"))
    right = pairs.agg((F.sum("h") / F.sum("n")).alias("accuracy_micro"))
    each = pairs.groupBy(F.col("predicted_label").alias("label")).agg((F.sum("h") / F.sum("n")).alias("p"))
    labels = pairs.select(F.col("true_label").alias("label")).union(pairs.select("predicted_label")).distinct()
    macro_ = labels.join(each, "label", "left").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("precision_macro"))
    return right.crossJoin(macro_).select("accuracy_micro", F.col("accuracy_micro").alias("precision_micro"), "precision_macro")  # one row each


def attach_crop_results(ann: DataFrame, *results: DataFrame) -> DataFrame:
    """ann with cropmodel_label and cropmodel_score of one model's results (ann_id, label, score), numbered from 0 for several."""
    for k, r in enumerate(results):
        tail = "" if len(results) == 1 else f"_{k}"
        ann = ann.join(r.select("ann_id", F.col("label").alias(f"cropmodel_label{tail}"), F.col("score").alias(f"cropmodel_score{tail}")), "ann_id", "left")
    return ann


def confusion(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"))


def class_weights(ann: DataFrame) -> DataFrame:
    """The inverse of each row's class count; counts join back, so a large class is not one task's window."""
    n = ann.groupBy("label").agg(F.count("*").alias("_n"))
    return ann.join(n, "label").withColumn("weight", F.lit(1.0) / F.col("_n")).drop("_n")


def label_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("label").union(b.select("label")).distinct()


def metrics_long(row: DataFrame) -> DataFrame:
    """One row of metrics as rows (metric, value)."""
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))).alias("m")).select("m.*")


def best_class(df: DataFrame, vector: str = "scores") -> DataFrame:
    """label (the first greatest place) and score of a vector of class scores."""
    top = F.array_max(vector)
    return df.withColumn("label", (F.array_position(vector, top) - 1).cast("int")).withColumn("score", top)

