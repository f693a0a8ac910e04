"""Greedy suppression of groups that no task should hold, such as an image of hundreds of thousands of boxes.

A group is cut along x twice. Parts of about TASK boxes, by a histogram of where boxes begin, are dealt to tasks; a smaller group is one part. Each part is cut into strips of
about `crowd` boxes by its task. A box stands in each part and strip that it touches, so two boxes that overlap meet in a strip. Rounds decide boxes by dominance: a strip is
gone through from the highest score down, and a box there is dropped if a kept one is too like it, free if no stronger one that is left is, and open as long as such a one is
undecided. A box that is dropped in one strip is dropped, one that is free in all of its strips is kept.

A task goes on with the rounds of its part while they decide anything, so tables are only made of what is kept, and of boxes that wait for one in several parts. What was kept
drops all that are like it in the next round, and is not needed after it. The strongest undecided box is decided in every round, and most are in the first two.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes
from ..functions import geometry as G
from ..functions.boxes import DROPPED, FREE, OPEN, diou, iou
from ..sources.scratch import removed, written

#: Boxes of a strip, on average, if not said; boxes of a part, on average; bins of the histogram that parts are made of.
CROWD, TASK, BINS = 4096, 4096, 1 << 16
#: Bytes up to which the parts of groups are broadcast.
SMALL = 32 << 20


def _parts(dets: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, the extent along x, and the bins that parts begin with, of the groups that have more than one part."""
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    extent = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(low).alias("_low"), (F.max(high) - F.min(low)).alias("_wide")).filter((F.col("_n") > most) & (F.col("_wide") > 0))
    extent = written(extent, "extents")
    if not extent.limit(1).count():
        return extent.select(*keys, "_low", "_wide", F.array(F.lit(0)).alias("_begin"))
    bins = dets.join(extent, keys).groupBy(*keys, "_low", "_wide", _bin(low).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    bins = bins.withColumn("_part", F.floor(F.coalesce(before, F.lit(0)) / most).cast("int"))
    first = bins.groupBy(*keys, "_low", "_wide", "_part").agg(F.min("_bin").alias("_bin"))
    return written(first.groupBy(*keys, "_low", "_wide").agg(F.array_sort(F.collect_list("_bin")).alias("_begin")).filter(F.size("_begin") > 1), "parts")


def _bin(x: Column) -> Column:
    return F.least(F.floor((x - F.col("_low")) / F.col("_wide") * BINS), F.lit(BINS - 1)).cast("int")


def strips(box: np.ndarray, part: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last strip of each box, numbered over all parts (part: each box's, rising): a part's strips begin where every crowd-th of its boxes does."""
    low, high = np.minimum(box[:, 0], box[:, 2]), np.maximum(box[:, 0], box[:, 2])
    order = np.lexsort((low, part))
    place = np.arange(len(part)) - np.searchsorted(part, part)
    begin = order[place % crowd == 0]
    at, x = np.concatenate([part[begin], part, part]), np.concatenate([low[begin], low, high])
    asks = np.arange(len(x)) >= len(begin)
    order = np.lexsort((asks, x, at))
    strip = np.empty(len(x), int)
    strip[order] = np.cumsum(~asks[order]) - 1
    return strip[len(begin) : len(begin) + len(low)], strip[len(begin) + len(low) :]


def decided(box: np.ndarray, part: np.ndarray, sure: np.ndarray, inside: np.ndarray, like: Callable, threshold: float, crowd: int) -> np.ndarray:
    """Verdicts on boxes in parts, in falling order in each, by rounds over strips as long as they decide any. sure: kept before; inside: in no other part. A box that is not
    inside is FREE if nothing in its part is in its way; it is not kept, and what is like it is OPEN."""
    first, last = strips(box, part, crowd)
    n = last - first + 1
    out = np.where(sure, FREE, OPEN)
    owner, strip = boxes.ranges(first, n)
    order = np.lexsort((owner, strip))
    owner, strip = owner[order], strip[order]
    now = sure.copy()  # what was kept in the round before
    while True:
        live = (out[owner] == OPEN) | now[owner] | (~inside[owner] & ~sure[owner] & (out[owner] == FREE))
        own, at = owner[live], strip[live]
        verdict = boxes.decide(box[own], np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)]), now[own], (n == 1)[own] & inside[own], like, threshold)
        was, judged = out.copy(), np.unique(own[~now[own]])
        dropped, free = np.zeros(len(out), bool), np.bincount(own[verdict == FREE], minlength=len(out)) == n
        dropped[own[verdict == DROPPED]] = True
        out[judged] = np.where(dropped[judged], DROPPED, np.where(free[judged], FREE, OPEN))
        now = (out == FREE) & (was == OPEN) & inside & (n > 1)
        if not ((out != was) & (inside | (out == DROPPED))).any():
            return out


def suppressed(dets: DataFrame, keys: tuple[str, ...], like: Callable, threshold: float, crowd: int = CROWD) -> DataFrame:
    """The rows of dets (keys, det_id, unique in a group, score, x1, y1, x2, y2 and more) that greedy suppression keeps: by falling score, then det_id, a box goes if it
    is more like a kept one than the threshold (0 or more). like: iou, or diou."""
    if threshold < 0:
        raise ValueError("boxes that do not overlap would have to meet")
    own = list(keys)
    parts = _parts(dets, own, max(crowd, TASK))
    size = parts.agg(F.sum(F.size("_begin") * 4 + 200)).first()[0] or 0
    rows, zero = dets, F.lit(0)
    whole = [zero.alias("_first"), F.lit(1).alias("_parts"), zero.alias("_part"), F.lit(False).alias("_sure")]
    if size:
        at = lambda x: F.coalesce(F.size(F.filter("_begin", lambda b: b <= _bin(x))) - 1, zero)
        rows = dets.join(F.broadcast(parts) if size <= SMALL else parts, own, "left").withColumns({"_first": at(F.least("x1", "x2")), "_end": at(F.greatest("x1", "x2"))})
        rows = rows.select(*dets.columns, "_first", (F.col("_end") - F.col("_first") + 1).alias("_parts"), F.explode(F.sequence("_first", "_end")).alias("_part"), F.lit(False).alias("_sure"))
    else:
        rows = dets.select("*", *whole)
    kind = T.StructType([*rows.schema.fields, T.StructField("_verdict", T.IntegerType())])

    def judge(batches):
        """Batches sorted by part and falling order. What is decided against goes, but for boxes in several parts, whose verdicts are yet to meet."""
        for part, first in boxes.whole_groups(batches, [*own, "_part"]):
            sure, inside = part.column("_sure").to_numpy(zero_copy_only=False), part.column("_parts").to_numpy() == 1
            verdict = decided(boxes.edges(part), np.repeat(np.arange(len(first)), np.diff(np.append(first, part.num_rows))), sure, inside, like, threshold, crowd)
            out = pa.RecordBatch.from_arrays([*[part.column(c) for c in kind.names[:-1]], pa.array(verdict, pa.int32())], names=kind.names)
            yield out.filter(pa.array(~sure & ((verdict != DROPPED) | ~inside)))

    def dealt(state: DataFrame) -> DataFrame:
        """Sorted parts. Where each group is one, a window asks for them, which deals boxes again only if they are not dealt by their keys (or some of them) already."""
        if size:
            return state.repartition(*own, "_part").sortWithinPartitions(*own, "_part", F.desc("score"), "det_id")
        return dets.withColumn("_place", F.row_number().over(W.partitionBy(*own).orderBy(F.desc("score"), "det_id"))).select(*dets.columns, *whole, "_place")  # nobody reads the place, but without it the window would go

    kept, state = None, rows
    while True:
        judged = written(dealt(state).mapInArrow(judge, kind), "judged")
        if state is not rows:
            removed(state)
        more = judged.filter((F.col("_parts") == 1) & (F.col("_verdict") == FREE)).select(*dets.columns)
        kept = more if kept is None else kept.unionByName(more)
        if not judged.filter((F.col("_parts") > 1) | (F.col("_verdict") == OPEN)).limit(1).count():
            return kept
        across = judged.filter("_parts > 1").groupBy(*own, "det_id").agg(F.min("_verdict").alias("_least"), F.sum((F.col("_verdict") == FREE).cast("int")).alias("_free"), F.first("_parts").alias("_of"))
        status = F.when(F.col("_least") == DROPPED, DROPPED).when(F.col("_free") == F.col("_of"), FREE).otherwise(OPEN)
        across = written(across.select(*own, "det_id", status.alias("_now")), "across")
        both = judged.filter("_parts > 1").join(across.withColumnsRenamed({c: f"_{c}" for c in (*own, "det_id")}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in own] + [F.col("det_id") == F.col("_det_id")]).filter(F.col("_now") != DROPPED)
        kept = kept.unionByName(both.filter((F.col("_now") == FREE) & (F.col("_part") == F.col("_first"))).select(*dets.columns))
        open_ = judged.filter((F.col("_parts") == 1) & (F.col("_verdict") == OPEN)).select(*rows.columns)
        left = open_.unionByName(both.withColumn("_sure", F.col("_now") == FREE).select(*rows.columns))
        left = written(left, "left")
        live = left.filter(~F.col("_sure")).select(*own, "_part").distinct()  # parts with nothing open are done
        if not live.limit(1).count():
            return kept
        state = written(left.join(live.withColumnsRenamed({c: f"_{c}" for c in (*own, "_part")}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*own, "_part")], "left_semi"), "state")
        removed(left)


def nms(dets: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("image_id",), crowd: int = CROWD) -> DataFrame:
    """As suppression.nms: for each label, IoU over the threshold."""
    return suppressed(dets, (*keys, "label"), iou, threshold, crowd)


def cluster_diou_nms(dets: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("image_id",), crowd: int = CROWD) -> DataFrame:
    """As suppression.cluster_diou_nms: over all labels together, DIoU over the threshold."""
    return suppressed(dets, keys, diou, threshold, crowd)
