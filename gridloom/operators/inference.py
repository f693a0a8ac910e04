"""Detector output: decoding, reprojection of tile detections, and the composed pipeline behind an engine interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import EDGES, unit
from ..sources.scratch import spread
from . import failures
from .suppression import suppress

DETECTIONS = "image_id long, tile_x int, tile_y int, label int, score double, x1 double, y1 double, x2 double, y2 double"
#: Engines by the start of a model's name.
ENGINES = {"YOLO": "yolo", "FASTER": "faster_rcnn", "DETR": "detr"}
#: Whether an engine keeps a score equal to the threshold.
KEEPS_EQUAL = {"yolo": True, "faster_rcnn": True, "detr": False}


def confident(dets: DataFrame, threshold: float, engine: str = "yolo") -> DataFrame:
    s = F.col("score")
    return dets.filter(s >= threshold if KEEPS_EQUAL[engine] else s > threshold)


def reproject(dets: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """Detections in tile pixels (with tile_x, tile_y, width, height of the image) as normalised boxes of the image, within it; empty ones go."""
    s = F.lit(scale) if isinstance(scale, (int, float)) else scale
    at = {e: unit((F.col(e) / s + F.col("tile_x" if e[0] == "x" else "tile_y")) / F.col("width" if e[0] == "x" else "height")) for e in EDGES}
    return dets.withColumns(at).filter("x2 > x1 AND y2 > y1")


def decode_queries(queries: DataFrame, threshold: float) -> DataFrame:
    """Rows with logits (array; the last is no object) as label and score: softmax, the best real class, if above the threshold."""
    top = F.array_max("logits")
    exps = F.transform("logits", lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    real = F.transform(F.slice(exps, 1, F.size("logits") - 1), lambda v: v / total)
    rows = queries.withColumn("_p", real).filter(F.size("logits") > 1)
    rows = rows.withColumns({"score": F.array_max("_p"), "label": (F.array_position("_p", F.array_max("_p")) - 1).cast("int")})
    return rows.drop("_p").filter(F.col("score") > threshold)


def pixels(dets: DataFrame) -> DataFrame:
    """Corners in whole pixels (cut off) of the image."""
    return dets.withColumns({f"px_{e}": (F.col(e) * F.col("width" if e[0] == "x" else "height")).cast("int") for e in EDGES})


def resize_scale(width: Column, height: Column, side: int = 640) -> Column:
    return F.lit(float(side)) / F.greatest(width, height)


def run_engine(tiles: DataFrame, engine: Callable[[Iterator], Iterator], schema: str = DETECTIONS) -> DataFrame:
    """engine: from an iterator of pandas frames of tiles to one of detections in tile pixels; it loads its model once in a worker."""
    return tiles.mapInPandas(engine, schema)


def with_whole(images: DataFrame, tiles: DataFrame) -> DataFrame:
    """tiles and each whole image as one more tile."""
    whole = images.select("image_id", "width", "height", F.lit(-1).alias("row_index"), F.lit(-1).alias("column_index"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("tile_width"), F.col("height").alias("tile_height"))
    own = ["image_id", "width", "height", "row_index", "column_index", "x", "y", "tile_width", "tile_height"]
    return tiles.select(*own).unionByName(whole)


def collected(images: DataFrame, tiles: DataFrame, engine: Callable[[Iterator], Iterator], floor: float = 0.1, engine_kind: str = "yolo", whole: bool = True) -> DataFrame:
    """Raw normalised detections of images (image_id, width, height) through their tiles, and as a whole if wanted, from a low score on. Numbered
    within an image by score, then by place, so the numbers are the same whenever a task runs again."""
    return _numbered(run_engine(with_whole(images, tiles) if whole else tiles, engine), images, floor, engine_kind)


def _numbered(found: DataFrame, images: DataFrame, floor: float, engine_kind: str) -> DataFrame:
    found = confident(found, floor, engine_kind)
    raw = reproject(found.join(images.select("image_id", "width", "height"), "image_id")).drop("width", "height")
    order = W.partitionBy("image_id").orderBy(F.desc("score"), "tile_y", "tile_x", "label", *EDGES)
    return raw.withColumn("det_id", F.row_number().over(order).cast("long"))


def infer(images: DataFrame, tiles: DataFrame, engine: Callable[[Iterator], Iterator], method: str = "wbf", conf: float = 0.25, iou: float = 0.45, engine_kind: str = "yolo", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(raw, final) normalised detections of images (image_id, width, height) through their tiles."""
    raw = collected(images, tiles, engine, conf, engine_kind, whole)
    return raw, suppress(raw, method, iou)


def infer_captured(images: DataFrame, tiles: DataFrame, load: Callable[[], Callable], method: str = "wbf", conf: float = 0.25, iou: float = 0.45, engine_kind: str = "yolo", whole: bool = False) -> tuple[DataFrame, DataFrame, failures.Outcome]:
    """(raw, final, outcome by image): as infer, but an image with a tile on which the engine raises has no detections and stands in outcome.failures with the error of
    its first such tile, row by row of tiles. load: see failures.captured."""
    rows = with_whole(images, tiles) if whole else tiles.select("image_id", "width", "height", "row_index", "column_index", "x", "y", "tile_width", "tile_height")
    rows = rows.repartition(spread(rows.sparkSession), "image_id")  # a file of images is one task, whatever number of tiles they have; an image's tiles stay together, so failures share halves
    order = ("row_index", "column_index")
    outcome = failures.by_group(failures.captured(rows, load, DETECTIONS, ("image_id", *order), "image_id", order), "image_id", order)
    raw = _numbered(outcome.results, images, conf, engine_kind)
    return raw, suppress(raw, method, iou), outcome


def summary(images: DataFrame, raw: DataFrame, final: DataFrame) -> DataFrame:
    """For each image: raw and final counts, duplicates_removed, and the final scores' least, greatest and mean to 3 digits (null without any)."""
    n = raw.groupBy("image_id").agg(F.count(F.lit(1)).alias("raw_count"))
    s = final.groupBy("image_id").agg(F.count(F.lit(1)).alias("final_count"), *[F.round(f("score"), 3).alias(f"score_{k}") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    own = images.select("image_id").join(n, "image_id", "left").join(s, "image_id", "left").fillna(0, ["raw_count", "final_count"])
    return own.withColumn("duplicates_removed", F.col("raw_count") - F.col("final_count"))


def with_full_image(mode: str, wanted: bool | None = None) -> bool:
    """Whether the whole image is inferred beside its tiles: on for adaptive modes unless said."""
    return mode in ("asahi", "asahi_rect") if wanted is None else wanted


def engine_of(model: str | Column):
    """The engine of a model's name; ValueError (or null for a column) if no engine has it."""
    if isinstance(model, Column):
        out = F.lit(None).cast("string")
        for prefix, name in reversed(ENGINES.items()):
            out = F.when(F.upper(model).startswith(prefix), name).otherwise(out)
        return out
    for prefix, name in ENGINES.items():
        if model.upper().startswith(prefix):
            return name
    raise ValueError(f"no engine for model {model!r}; names start with {', '.join(ENGINES)}")
