"""Precision, recall, average precision and counting errors over matches."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prefix
from ..sources.scratch import written
from .matching import best_truth

#: The IoU thresholds are these very doubles (the sixth is above 0.75), and the recall levels are i times 0.01.
IOU_THRESHOLDS = [float(t) for t in np.arange(0.5, 1.0, 0.05)]
LEVELS = 101
EPS = 1e-9


def prf(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 of summed tp, fp and fn, each denominator with 1e-9 added."""
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    return sums.withColumns({"precision": p, "recall": r}).withColumn("fscore", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))


def pearson(truth: Column, seen: Column) -> Column:
    """Pearson's r as an aggregate: 0 for one row or a constant truth, null (undefined) for a constant prediction."""
    flat = (F.count(truth) <= 1) | (F.coalesce(F.stddev_pop(truth), F.lit(0.0)) == 0)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(truth, seen), F.stddev_pop(truth) * F.stddev_pop(seen)))


def counting_errors(rows: DataFrame, keys: tuple[str, ...] = (), truth: str = "groundtruth", seen: str = "predicted") -> DataFrame:
    """MAE, RMSE and Pearson's r of counts."""
    gap = (F.col(seen) - F.col(truth)).cast("double")
    return rows.groupBy(*keys).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), pearson(F.col(truth).cast("double"), F.col(seen).cast("double")).alias("pearson_r"))


def pooled_errors(rows: DataFrame, keys: tuple[str, ...], truth: str = "groundtruth", seen: str = "predicted") -> DataFrame:
    """counting_errors and MAPE (of rows with a truth above 0)."""
    own = counting_errors(rows, keys, truth, seen)
    part = F.when(F.col(truth) > 0, F.abs(F.col(seen) - F.col(truth)) / F.col(truth))
    return own.join(rows.groupBy(*keys).agg((F.avg(part) * 100).alias("mape")), list(keys)) if keys else own.crossJoin(rows.agg((F.avg(part) * 100).alias("mape")))


def average_precision(found: DataFrame, n_truth: DataFrame, group: tuple[str, ...] = (), keys: tuple[str, ...] = ("image_id",), thresholds: list[float] | None = None) -> DataFrame:
    """ap for each group and iou_threshold: the mean over 101 recall levels of the best precision at that recall or more.

    n_truth: a row for each group with n_gt. A group without truth or without detections has ap 0. Detections are ranked once for all thresholds, by falling score,
    then keys and det_id, in ranges of that order (see prefix.running), so no task sorts a group and equal scores may span tasks. Recall rises and precision peaks at
    hits alone, so only hits are looked at for each threshold.
    """
    steps, parts = thresholds or IOU_THRESHOLDS, ["iou_threshold", *group]
    rows = hits(found, steps)
    rows = written(rows.select(*group, *keys, "det_id", "score", *[c for c in rows.columns if c.startswith("hit_")]), "hits")  # ranges of an order take two passes
    best = best_precision(rows, n_truth, steps, group, keys)
    grid = n_truth.select(*group, F.explode(F.array(*map(F.lit, steps))).alias("iou_threshold"))
    return grid.join(mean_precision(best, parts), parts, "left").fillna(0.0, ["ap"])


def hits(found: DataFrame, thresholds: list[float]) -> DataFrame:
    """found with hit_0, hit_1, ...: whether the detection is a match at each IoU threshold. It is if its IoU reaches the threshold and that of no stronger detection of its
    best truth does, so the largest IoU of those before it (before, see best_truth) settles all thresholds at once."""
    return found.withColumns({f"hit_{i}": F.coalesce((F.col("iou") >= t) & (F.col("before") < t), F.lit(False)) for i, t in enumerate(thresholds)}).drop("before")


def best_precision(rows: DataFrame, n_truth: DataFrame, thresholds: list[float], group: tuple[str, ...] = (), keys: tuple[str, ...] = ("image_id",), more: tuple[str, ...] = ()) -> DataFrame:
    """iou_threshold, group, further columns, level (of recall, 0 to 100), precision: the best at each level that hits have, of rows with hits."""
    parts, each = ["iou_threshold", *group], {f"hits_{i}": F.col(f"hit_{i}") for i in range(len(thresholds))}
    rows = rows.select(*group, *keys, "det_id", "score", *more, *[f"hit_{i}" for i in range(len(thresholds))])
    any_hit = reduce(or_, [F.col(f"hit_{i}") for i in range(len(thresholds))])
    wanted = [*group, *more, *[f"hit_{i}" for i in range(len(thresholds))]]
    rows = prefix.running(rows, [F.desc("score"), *keys, "det_id"], {"seen": F.lit(1), **each}, group, None, any_hit, wanted)
    one = F.array(*[F.when(F.col(f"hit_{i}"), F.struct(F.lit(t).alias("iou_threshold"), F.col(f"hits_{i}").alias("hits"))) for i, t in enumerate(thresholds)])
    rows = rows.select(*group, *more, "seen", F.inline(one)).filter("hits IS NOT NULL")
    rows = rows.join(F.broadcast(n_truth), list(group)) if group else rows.crossJoin(F.broadcast(n_truth))
    rows = rows.filter("n_gt > 0").select(*parts, *more, (F.col("hits") / F.col("n_gt")).alias("recall"), (F.col("hits") / (F.col("seen") + EPS)).alias("precision"))
    near = F.floor(F.col("recall") * 100)
    level = F.when((near + 1) * 0.01 <= F.col("recall"), near + 1).when(near * 0.01 > F.col("recall"), near - 1).otherwise(near).cast("int")
    return rows.groupBy(*parts, *more, level.alias("level")).agg(F.max("precision").alias("precision"))


def mean_precision(best: DataFrame, parts: list[str]) -> DataFrame:
    """parts, ap: the mean over recall levels of the best precision at that level or more."""
    every = best.groupBy(*parts).agg(F.collect_list(F.struct("level", "precision")).alias("best"))
    at = lambda i: F.coalesce(F.array_max(F.transform(F.filter("best", lambda b: b["level"] >= i), lambda b: b["precision"])), F.lit(0.0))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at), F.lit(0.0), lambda a, x: a + x) / LEVELS
    return every.select(*parts, total.alias("ap"))


def map_summary(ap: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """map50, map75 and map (over all thresholds)."""
    at = lambda t: F.max(F.when(F.col("iou_threshold") == t, F.col("ap")))
    return ap.groupBy(*group).agg(at(IOU_THRESHOLDS[0]).alias("map50"), at(IOU_THRESHOLDS[5]).alias("map75"), F.avg("ap").alias("map"))


def evaluate(dets: DataFrame, truths: DataFrame, group: tuple[str, ...] = (), keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """map_summary of detections against truth, by group."""
    both = (*group, *keys)
    n_truth = truths.groupBy(*group).agg(F.count(F.lit(1)).alias("n_gt"))
    return map_summary(average_precision(best_truth(dets, truths, both), n_truth, group, keys), group)
