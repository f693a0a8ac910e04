"""Score threshold sweeps: filter, suppress, match, for every threshold and group in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import metrics
from .matching import best_truth, counting, matched
from .suppression import PREFIX, suppress

#: Thresholds of the validation curve, of the metric cube and of the scatter plots.
VALIDATION = [round(0.10 + 0.05 * i, 2) for i in range(15)]
CUBE = [round(0.10 + 0.02 * i, 2) for i in range(45)]
SCATTER = [round(0.10 + 0.05 * i, 2) for i in range(18)]


def at_thresholds(dets: DataFrame, thresholds: list[float], method: str = "nms", iou: float = 0.5, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Detections that stay at each score threshold (column threshold).

    Where a box's fate depends on higher scores alone, one suppression at the lowest threshold serves all; other methods run once for each.
    """
    if method in PREFIX:
        return suppress(dets.filter(F.col("score") >= min(thresholds)), method, iou, keys).select("*", _reached(thresholds))
    return suppress(dets.select("*", _reached(thresholds)), method, iou, ("threshold", *keys))


def _reached(thresholds: list[float]) -> Column:
    """A row for each threshold that the score reaches."""
    return F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score"))).alias("threshold")


def fold_metrics(images: DataFrame, dets: DataFrame, truths: DataFrame, thresholds: list[float], method: str = "nms", iou: float = 0.5, group: tuple[str, ...] = ("fold",), keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """For each threshold and group: map50, precision, recall, fscore, mae. keys must name an image over all groups; images have group and keys."""
    if method in PREFIX:
        return _prefix_metrics(images, dets, truths, sorted(set(thresholds)), method, iou, group, keys)
    both = (*group, *keys)
    steps = images.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    grid = images.select(*both).crossJoin(F.broadcast(steps))
    wide = ("threshold", *both)
    kept = at_thresholds(dets, thresholds, method, iou, both)
    found = best_truth(kept, truths.crossJoin(F.broadcast(steps)), wide)
    n_truth = truths.groupBy(*group).agg(F.count(F.lit(1)).alias("n_gt")).crossJoin(F.broadcast(steps))
    ap = metrics.average_precision(found, n_truth, ("threshold", *group), keys, [metrics.IOU_THRESHOLDS[0]])
    rows = counting(grid, truths.crossJoin(F.broadcast(steps)), kept, matched(found, 0.5, wide), wide)
    out = metrics.prf(rows, ("threshold", *group)).join(metrics.counting_errors(rows, ("threshold", *group)), ["threshold", *group])
    return out.join(ap.select("threshold", *group, F.col("ap").alias("map50")), ["threshold", *group]).select("threshold", *group, "map50", "precision", "recall", "fscore", "mae")


def _prefix_metrics(images: DataFrame, dets: DataFrame, truths: DataFrame, thresholds: list[float], method: str, iou: float, group: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """As fold_metrics where what stays at a threshold is what stays at the lowest one, cut by score: a box's fate, its best truth, whether it is a match and its place in the
    order of scores are then the same at every threshold, so each is worked out once and no row is repeated for thresholds but an image's counts, inside an aggregate."""
    both, n = (*group, *keys), len(thresholds)
    at = metrics.IOU_THRESHOLDS[:1]
    reached = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score")))
    found = best_truth(dets.filter(F.col("score") >= thresholds[0]), truths, both, method, iou)
    found = written(metrics.hits(found, at).select(*both, "det_id", "score", "hit_0", reached.alias("reached")), "kept")
    n_truth = truths.groupBy(*both).agg(F.count(F.lit(1)).alias("g"))
    counts = [F.sum((F.col("reached") > i).cast("long")).alias(f"p{i}") for i in range(n)] + [F.sum(((F.col("reached") > i) & F.col("hit_0")).cast("long")).alias(f"t{i}") for i in range(n)]
    rows = images.select(*both).distinct().join(n_truth, list(both), "left").join(found.groupBy(*both).agg(*counts), list(both), "left").fillna(0)
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"p{i}").alias("p"), F.col(f"t{i}").alias("t")) for i, t in enumerate(thresholds)])
    rows = rows.select(*group, "g", F.inline(each)).select("threshold", *group, F.col("t").alias("tp"), (F.col("p") - F.col("t")).alias("fp"), (F.col("g") - F.col("t")).alias("fn"), F.abs(F.col("p") - F.col("g")).alias("gap"))
    sums = rows.groupBy("threshold", *group).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg("gap").alias("mae"))
    out = metrics.prf(sums, ("threshold", *group)).join(sums.select("threshold", *group, "mae"), ["threshold", *group])
    gt = truths.groupBy(*group).agg(F.count(F.lit(1)).alias("n_gt"))
    best = metrics.best_precision(found, gt, at, group, keys, ("reached",))  # a row for each fold, level and number of thresholds reached
    steps = F.explode(F.slice(F.array(*map(F.lit, thresholds)), F.lit(1), F.col("reached"))).alias("threshold")
    best = best.select(*group, "level", "precision", steps).groupBy("threshold", *group, "level").agg(F.max("precision").alias("precision"))
    grid = gt.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), *group)
    ap = grid.join(metrics.mean_precision(best, ["threshold", *group]), ["threshold", *group], "left").fillna(0.0, ["ap"])
    return out.join(ap.withColumnRenamed("ap", "map50"), ["threshold", *group]).select("threshold", *group, "map50", "precision", "recall", "fscore", "mae")


def curve(by_fold: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Means over folds of fold metrics (not pooled), for each threshold."""
    return by_fold.groupBy(*group, "threshold").agg(*[F.avg(c).alias(c) for c in ("map50", "precision", "recall", "fscore", "mae")])


def best_threshold(curves: DataFrame, group: tuple[str, ...] = (), score: str = "fscore") -> DataFrame:
    """The row with the largest score, of equals that with the lowest threshold."""
    rank = F.row_number().over(W.partitionBy(*(group or [F.lit(1)])).orderBy(F.desc(score), "threshold"))
    return curves.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def nearest_threshold(curves: DataFrame, wanted: float, group: tuple[str, ...] = ()) -> DataFrame:
    """The row whose threshold is nearest to wanted, of equals the first."""
    rank = F.row_number().over(W.partitionBy(*(group or [F.lit(1)])).orderBy(F.abs(F.col("threshold") - wanted), "threshold"))
    return curves.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def apply_selected(best: DataFrame, test: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Test metrics at the threshold selected on validation."""
    chosen = best.select(*group, "threshold")
    return test.join(F.broadcast(chosen), [*group, "threshold"])


def summary(test: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Mean and sample deviation over folds of each metric; one fold has no deviation (null)."""
    cols = ("map50", "precision", "recall", "fscore", "mae")
    return test.groupBy(*group).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_samp(c).alias(f"{c}_std") for c in cols])


def displayed(test: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """As summary, with 0 for a single fold's deviation."""
    own = summary(test, group)
    return own.fillna(0.0, [c for c in own.columns if c.endswith("_std")])


def cube(by_fold: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """The dashboard's cube as one JSON object for each group: threshold to fold to rounded metrics."""
    values = F.array(*[F.round(c, d) for c, d in (("map50", 4), ("precision", 4), ("recall", 4), ("fscore", 4), ("mae", 3))])
    folds = by_fold.groupBy(*group, "threshold").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("fold").cast("string").alias("k"), values.alias("v"))))).alias("folds"))
    entry = F.struct(F.format_string("%.2f", "threshold").alias("k"), F.col("folds").alias("v"))
    return folds.groupBy(*group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry), _by_key))).alias("metrics"))


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def scatter(images: DataFrame, kept: DataFrame, truths: DataFrame, thresholds: list[float] | None = None, keys: tuple[str, ...] = ("fold", "image_id")) -> DataFrame:
    """For each image its true count and its predicted counts by threshold."""
    n = kept.groupBy(*keys, "threshold").agg(F.count(F.lit(1)).alias("n"))
    true = truths.groupBy(*keys).agg(F.count(F.lit(1)).alias("gt"))
    grid = images.select(*keys).select("*", F.explode(F.array(*map(F.lit, thresholds or SCATTER))).alias("threshold"))
    rows = grid.join(n, [*keys, "threshold"], "left").join(true, list(keys), "left").fillna(0, ["n", "gt"])
    return rows.groupBy(*keys).agg(F.first("gt").alias("gt"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("threshold", "n")))).alias("pred"))


def suggested(curves: DataFrame, modes: list[str], prefer: str = "asahi_rect") -> DataFrame:
    """The best threshold of the preferred mode if its curve (column mode) is among those shown, else of the first shown."""
    return best_threshold(curves.filter(F.col("mode") == (prefer if prefer in modes else modes[0])))
