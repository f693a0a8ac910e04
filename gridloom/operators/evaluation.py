"""Evaluation of raw detections for all setups, models and folds in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import metrics
from .matching import best_truth, counting, matched
from .suppression import LIKE, suppress


def evaluate(images: DataFrame, truths: DataFrame, raw: DataFrame, method: str = "nms", iou: float = 0.5, threshold: float = 0.5, group: tuple[str, ...] = ("fold",), keys: tuple[str, ...] = ("image_id",)) -> tuple[DataFrame, DataFrame]:
    """(results by group, counting rows by image): suppression, matching at the threshold, AP over all thresholds, precision and recall, counting errors.

    images have group and keys; so do truths and raw detections.
    """
    both = (*group, *keys)
    found = best_truth(raw, truths, both, method, iou) if method in LIKE else best_truth(suppress(raw, method, iou, both), truths, both)
    found = written(found, "found")  # all results come from these matches
    rows = counting(images, truths, raw, matched(found, threshold, both), both)
    n_truth = truths.groupBy(*group).agg(F.count(F.lit(1)).alias("n_gt"))
    ap = metrics.map_summary(metrics.average_precision(found, n_truth, group, keys), group)
    out = metrics.prf(rows, group).join(metrics.counting_errors(rows, group), list(group)).join(ap, list(group), "left")
    return out.select(*group, "map50", "map75", "map", "precision", "recall", "fscore", "mae", "rmse", "pearson_r"), rows
