"""Greedy matching of detections to ground truth, without a loop.

A detection only ever tries the ground truth it overlaps most, so the matches are the best detection of each (image, best ground truth). Detections and
ground truth are dealt by image together; an Arrow batch of whole images is decided at once, in numpy (see functions.boxes), so no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes
from ..functions import geometry as G
from .suppression import LIKE


def best_truth(dets: DataFrame, truths: DataFrame, keys: tuple[str, ...] = ("image_id",), method: str | None = None, limit: float = 0.5) -> DataFrame:
    """keys, det_id, score, gt_id, iou: the ground truth with the largest IoU (the smallest gt_id of equals), null where none overlaps; and before, the largest IoU that a stronger
    detection (by score, then det_id) has with the same best truth, -1 without one. Rows with a null key and boxes with a missing edge overlap nothing.

    With a method (of suppression.LIKE) only what that suppression keeps takes part, without a shuffle of its own.
    """
    like, by_label = LIKE[method] if method else (None, False)
    more = ["label"] if by_label and "label" not in keys else []
    kind = {f.name: f.dataType for f in (*dets.schema, truths.schema["gt_id"])}
    none = lambda c: F.lit(None).cast(kind[c]).alias(c)
    own = dets.select(*keys, F.lit(True).alias("_det"), "det_id", "score", none("gt_id"), *more, *G.EDGES)
    other = truths.select(*keys, F.lit(False).alias("_det"), none("det_id"), none("score"), "gt_id", *map(none, more), *G.EDGES)
    both = own.unionByName(other)
    schema = T.StructType([*[both.schema[c] for c in (*keys, "det_id", "score", "gt_id")], T.StructField("iou", T.DoubleType()), T.StructField("before", T.DoubleType())])

    def stream(batches):
        for rows, first in boxes.whole_groups(batches, list(keys)):
            rows, group, n_truth, first = _kept(rows, first, like, limit, ["label"] if by_label else [])
            lost = np.any([rows.column(k).is_null().to_numpy(zero_copy_only=False) for k in keys], axis=0)
            is_det = rows.column("_det").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(is_det)
            best, iou = boxes.most_alike(boxes.edges(rows), at, first[group[at]], np.where(lost[at], 0, n_truth[group[at]]))
            found = best >= 0
            before = np.full(len(at), -1.0)
            before[found] = boxes.largest_before(best[found], iou[found])
            out = rows.take(pa.array(at))
            gt = rows.column("gt_id").take(pa.array(best, mask=~found))
            yield pa.RecordBatch.from_arrays([*[out.column(c) for c in (*keys, "det_id", "score")], gt, pa.array(iou, mask=~found), pa.array(before)], schema.names)

    # A window asks for whole images in this order, and deals boxes again only where they are not dealt by image (or a part of keys) already.
    dealt = both.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy("_det", F.desc("score"), "det_id", "gt_id")))
    return dealt.mapInArrow(stream, schema).select(*[F.col(k).cast(kind[k]).alias(k) for k in keys], "det_id", "score", "gt_id", "iou", "before")


def _kept(rows: pa.RecordBatch, first: np.ndarray, like: Callable | None, limit: float, more: list[str]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """Groups that have ground truth first and then detections in falling order, without the detections that suppression drops: rows, each one's group, and each group's
    ground truths and beginning."""
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
    is_det = rows.column("_det").to_numpy(zero_copy_only=False)
    if like:
        at = np.flatnonzero(is_det)
        codes = [rows.column(c).take(pa.array(at)).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in more]
        score = rows.column("score").take(pa.array(at))
        falling = np.where(score.is_null().to_numpy(zero_copy_only=False), -np.inf, -score.to_numpy(zero_copy_only=False).astype(float))  # as suppression orders them
        order = np.lexsort((np.arange(len(at)), falling, *codes, group[at]))
        new = np.append(True, np.any([c[order][1:] != c[order][:-1] for c in (group[at], *codes)], axis=0)) if len(at) else np.empty(0, bool)
        verdict = boxes.decide(boxes.edges(rows)[at[order]], np.flatnonzero(new), np.zeros(len(at), bool), np.ones(len(at), bool), like, limit)
        stays = ~is_det
        stays[at[order]] = verdict == boxes.FREE
        rows, group, is_det = rows.filter(pa.array(stays)), group[stays], is_det[stays]
    n_truth, size = np.bincount(group[~is_det], minlength=len(first)), np.bincount(group, minlength=len(first))
    return rows, group, n_truth, np.cumsum(size) - size


def match(dets: DataFrame, truths: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """best_truth and is_tp: the detection has the highest score (then the smallest det_id) of those whose best truth it is, at IoU >= threshold."""
    found = best_truth(dets, truths, keys)
    return matched(found, threshold, keys)


def matched(found: DataFrame, threshold: float, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """found (see best_truth) with is_tp instead of before."""
    return found.withColumn("is_tp", F.coalesce((F.col("iou") >= threshold) & (F.col("before") < threshold), F.lit(False))).drop("before")


def missed(matches: DataFrame, truths: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Ground truth that no detection matches."""
    return truths.join(matches.filter("is_tp").select(*keys, "gt_id"), [*keys, "gt_id"], "left_anti")


def counting(images: DataFrame, truths: DataFrame, raw: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """A row for each image, also one without boxes: groundtruth, raw_predicted, predicted, removed_by_suppression, tp, fp, fn."""
    one = F.count(F.lit(1))
    own = images.select(*keys).distinct()
    for df, name in ((truths, "groundtruth"), (raw, "raw_predicted")):
        own = own.join(df.groupBy(*keys).agg(one.alias(name)), list(keys), "left")
    own = own.join(matches.groupBy(*keys).agg(one.alias("predicted"), F.sum(F.col("is_tp").cast("long")).alias("tp")), list(keys), "left")
    own = own.fillna(0, ["groundtruth", "raw_predicted", "predicted", "tp"])
    return own.withColumns({"removed_by_suppression": F.col("raw_predicted") - F.col("predicted"), "fp": F.col("predicted") - F.col("tp"), "fn": F.col("groundtruth") - F.col("tp")})
