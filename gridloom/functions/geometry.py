"""Box geometry as column expressions. Boxes are four columns x1, y1, x2, y2 or a struct with these fields; all arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x1", "y1", "x2", "y2")


def corners(prefix: str = "") -> dict[str, Column]:
    """The four columns whose names start with prefix."""
    return {e: F.col(prefix + e) for e in EDGES}


def fields(box: Column) -> dict[str, Column]:
    return {e: box[e] for e in EDGES}


def _overlap(a, b) -> Column:
    wide = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    high = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return wide * high


def area(a) -> Column:
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union is empty, so it is never NaN."""
    both = _overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def diou(a, b, eps: float = 1e-7) -> Column:
    """IoU less the squared distance of centres over the squared diagonal of the hull, each denominator with eps added."""
    both = _overlap(a, b)
    union = area(a) + area(b) - both + eps
    return both / union - _distance(a, b) / (_diagonal(a, b) + eps)


def clamped_diou(a, b) -> Column:
    """DIoU with 0 for an empty union and a diagonal of at least 1e-6, negative sides counting as 0."""
    both = _overlap(a, b)
    side = lambda p: F.greatest(p["x2"] - p["x1"], F.lit(0.0)) * F.greatest(p["y2"] - p["y1"], F.lit(0.0))
    union = side(a) + side(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0)) - _distance(a, b) / F.greatest(_diagonal(a, b), F.lit(1e-6))


def _distance(a, b) -> Column:
    dx = (a["x1"] + a["x2"]) / 2 - (b["x1"] + b["x2"]) / 2
    dy = (a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2
    return dx * dx + dy * dy


def _diagonal(a, b) -> Column:
    wide = F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"])
    high = F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"])
    return wide * wide + high * high


def overlaps(a, b) -> Column:
    """Boxes with a positive common area."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def unit(x: Column) -> Column:
    """x within [0, 1]."""
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
