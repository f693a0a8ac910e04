"""Suppression and fusion of overlapping detections.

Detections are rows (keys, det_id, label, score, x1, y1, x2, y2). Groups (an image, or an image and a label) are dealt by their keys and sorted by falling score and then
det_id; an Arrow batch of whole groups is decided at once, in numpy steps that all of its groups take together (see functions.boxes). Groups are bounded by what one image holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import boxes
from ..functions import geometry as G

EPS_SKIP = 0.001


def _by_group(dets: DataFrame, keys: list[str], run: Callable, schema: T.StructType) -> DataFrame:
    """dets through run, which takes a record batch of whole groups in falling order and where they begin, and returns one of schema."""

    def stream(batches):
        for rows, first in boxes.whole_groups(batches, keys):
            yield run(rows, first)

    return dets.repartition(*keys).sortWithinPartitions(*keys, -F.col("score"), "det_id").mapInArrow(stream, schema)


def _kept(dets: DataFrame, keys: list[str], like: Callable, threshold: float) -> DataFrame:
    """Greedy suppression: a box stays unless it is too much like one that stays and has a higher score."""

    def run(rows, first):
        n = rows.num_rows
        verdict = boxes.decide(boxes.edges(rows), first, np.zeros(n, bool), np.ones(n, bool), like, threshold)
        return rows.filter(pa.array(verdict == boxes.FREE))

    return _by_group(dets, keys, run, dets.schema)


def nms(dets: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Greedy suppression for each label: IoU over the threshold."""
    return _kept(dets, [*keys, "label"], boxes.iou, threshold)


def cluster_diou_nms(dets: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Suppression over all labels together: DIoU over the threshold. The cluster iteration's fixed point is the greedy result."""
    return _kept(dets, list(keys), boxes.diou, threshold)


def bws(dets: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Box weighted suppression for each label: each dropped box joins the first kept box it overlaps by more than the threshold, and a
    kept box becomes the score-weighted mean of its cluster."""
    own = [*keys, "label"]
    kept = nms(dets, threshold, keys)
    seed = kept.select(*own, F.col("det_id").alias("seed_id"), F.col("score").alias("seed_score"), *[F.col(e).alias(f"s_{e}") for e in G.EDGES])
    pairs = dets.join(seed, own).filter((F.col("det_id") == F.col("seed_id")) | (G.iou(G.corners("s_"), G.corners()) > threshold))
    first = pairs.groupBy(*own, "det_id").agg(F.min(F.struct((-F.col("seed_score")).alias("o"), F.col("seed_id").alias("seed_id"))).alias("first"), *[F.first(c).alias(c) for c in ("score", *G.EDGES)])
    total = F.sum("score")
    fused = first.select(*own, F.col("first.seed_id").alias("det_id"), "score", *G.EDGES).groupBy(*own, "det_id").agg(F.max("score").alias("score"), *[(F.sum(F.col(e) * F.col("score")) / total).alias(e) for e in G.EDGES])
    return fused.select(*own, "det_id", "score", *G.EDGES)


def _boxes_by_group(dets: DataFrame, keys: list[str], run: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """run(boxes, scores, where groups begin), to the rows that stay, their boxes and scores."""
    schema = T.StructType([*[dets.schema[k] for k in keys], T.StructField("det_id", T.LongType()), T.StructField("score", T.DoubleType()), *[T.StructField(e, T.DoubleType()) for e in G.EDGES]])
    kind = to_arrow_schema(schema)

    def done(rows, first):
        at, box, score = run(boxes.edges(rows), rows.column("score").to_numpy(zero_copy_only=False).astype(float), first)
        same = rows.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*[same.column(k).cast(kind.field(k).type) for k in (*keys, "det_id")], pa.array(score), *[pa.array(box[:, i]) for i in range(4)]], schema=kind)

    return _by_group(dets.select(*keys, "det_id", "score", *G.EDGES), keys, done, schema)


def adaptive_nms(dets: DataFrame, tau: float = 0.5, k: int = 5, alpha: float = 0.1, least: float = 0.3, duplicate: float = 0.7, ratio: float = 0.5, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Suppression for each label with a threshold that falls where the best box's k most alike remaining boxes are dense: a box goes if its
    DIoU exceeds max(least, tau - alpha * their mean), or exceeds `duplicate` with at least `ratio` of the score."""

    def run(box, scores, first):
        at = boxes.adaptive(box, scores, first, tau, k, alpha, least, duplicate, ratio)
        return at, box[at], scores[at]

    return _boxes_by_group(dets, [*keys, "label"], run)


def wbf(dets: DataFrame, threshold: float = 0.45, skip: float = EPS_SKIP, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Weighted boxes fusion for each label, of one model: in falling order of scores each box joins the fused box that it overlaps most, if by
    more than the threshold, else it starts one. A fused box is the score-weighted mean of its boxes, its score their mean; det_id is the first's.
    Boxes are put in order and cut to the unit square first; empty ones go."""

    edges = {f"{c}{i}": G.unit(f(f"{c}1", f"{c}2")) for c in "xy" for i, f in ((1, F.least), (2, F.greatest))}
    whole = dets.filter(F.col("score") >= skip).withColumns(edges).filter((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) > 0)
    return _boxes_by_group(whole, [*keys, "label"], lambda box, scores, first: boxes.fused(box, scores, first, threshold))


METHODS: dict[str, Callable[..., DataFrame]] = {"nms": nms, "cluster_diou_nms": cluster_diou_nms, "nms_ioa": adaptive_nms, "bws": bws, "wbf": wbf}
#: Suppression that goes with each tiling mode.
BY_MODE = {"sahi": "nms", "none": "nms", "asahi": "cluster_diou_nms", "asahi_rect": "cluster_diou_nms"}
#: Greedy methods: what makes two boxes alike, and whether labels are apart.
LIKE = {"nms": (boxes.iou, True), "cluster_diou_nms": (boxes.diou, False)}
#: Methods whose result at a higher score threshold is what they keep at a lower one, cut at the higher.
PREFIX = set(LIKE)


def suppress(dets: DataFrame, method: str, threshold: float, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"no suppression {method!r}; known: {', '.join(METHODS)}")
    return METHODS[method](dets, threshold, keys=keys)
