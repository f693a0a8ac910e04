"""Training labels: boxes on tiles, on letterboxed images and on resized ones, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import prefix
from ..functions.geometry import unit
from .tiling import Tiling, letterbox, touched_tiles

LINE = "%d %.6f %.6f %.6f %.6f"


def tile_boxes(annotations: DataFrame, tiled: DataFrame, threshold: float = 0.4, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Boxes that a tile keeps: annotation columns, tile columns, ioa (the share of the box inside the tile) and the clipped box cx1..cy2 from the tile's
    corner. An equi-join on the image, with interval bounds; the share of an empty box is 0."""
    dup = [c for c in tiled.columns if c in annotations.columns and c not in keys]
    own = tiled.select(*[c for c in tiled.columns if c not in dup and c not in ("x", "y")], F.col("x").alias("tile_x"), F.col("y").alias("tile_y"))
    return _on_tiles(annotations.join(own, list(keys)), threshold)


def boxes_on_tiles(annotations: DataFrame, t: Tiling, threshold: float = 0.4) -> DataFrame:
    """As tile_boxes, for annotations with their image's width and height and a tiling: each box meets the tiles that it touches, by arithmetic, and no
    other (see tiling.touched_tiles); nothing is joined. The threshold is above 0, as at 0 a box stays on every tile of its image."""
    if threshold <= 0:
        raise ValueError("at a threshold of 0 use tile_boxes")
    return _on_tiles(touched_tiles(annotations, t), threshold)


def _on_tiles(both: DataFrame, threshold: float) -> DataFrame:
    x2, y2 = F.col("tile_x") + F.col("tile_width"), F.col("tile_y") + F.col("tile_height")
    near = (F.col("x") < x2) & (F.col("tile_x") < F.col("x") + F.col("w")) & (F.col("y") < y2) & (F.col("tile_y") < F.col("y") + F.col("h"))
    both = both.filter(near) if threshold > 0 else both
    cx1, cy1 = F.greatest(F.col("x"), F.col("tile_x")), F.greatest(F.col("y"), F.col("tile_y"))
    cx2, cy2 = F.least(F.col("x") + F.col("w"), x2), F.least(F.col("y") + F.col("h"), y2)
    part = F.greatest(cx2 - cx1, F.lit(0)) * F.greatest(cy2 - cy1, F.lit(0))
    area = F.col("w") * F.col("h")
    ioa = F.when(area > 0, part / area).otherwise(F.lit(0.0))
    return both.select("*", ioa.alias("ioa"), (cx1 - F.col("tile_x")).alias("cx1"), (cy1 - F.col("tile_y")).alias("cy1"), (cx2 - F.col("tile_x")).alias("cx2"), (cy2 - F.col("tile_y")).alias("cy2")).filter(F.col("ioa") >= threshold)


def normalised(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size over the picture's size, within [0, 1]."""
    return {"cx": unit((x + w / 2) / width), "cy": unit((y + h / 2) / height), "bw": unit(w / width), "bh": unit(h / height)}


def tile_labels(kept: DataFrame) -> DataFrame:
    """tile_boxes with cx, cy, bw, bh over the tile."""
    c = F.col
    return kept.withColumns(normalised(c("cx1"), c("cy1"), c("cx2") - c("cx1"), c("cy2") - c("cy1"), c("tile_width"), c("tile_height")))


def letterboxed(x: Column, y: Column, w: Column, h: Column, box: dict[str, Column], target: tuple[int, int]) -> dict[str, Column]:
    s = box["scale"]
    return {"cx": unit(((x + w / 2) * s + box["pad_x"]) / target[0]), "cy": unit(((y + h / 2) * s + box["pad_y"]) / target[1]), "bw": unit(w * s / target[0]), "bh": unit(h * s / target[1])}


def letterbox_labels(kept: DataFrame, target: tuple[int, int] = (640, 640)) -> DataFrame:
    """tile_boxes with cx, cy, bw, bh on the letterboxed tile."""
    c = F.col
    return kept.withColumns(letterboxed(c("cx1"), c("cy1"), c("cx2") - c("cx1"), c("cy2") - c("cy1"), letterbox(c("tile_width"), c("tile_height"), target), target))


def full_image_labels(annotations: DataFrame, target: tuple[int, int] = (640, 640)) -> DataFrame:
    """annotations (with width and height) on the letterboxed image; empty boxes go, no share is asked for."""
    c = F.col
    rows = annotations.filter("w > 0 AND h > 0")
    return rows.withColumns(letterboxed(c("x"), c("y"), c("w"), c("h"), letterbox(c("width"), c("height"), target), target))


def holdout_labels(annotations: DataFrame) -> DataFrame:
    """annotations over the image's own size; empty boxes go."""
    c = F.col
    return annotations.filter("w > 0 AND h > 0").withColumns(normalised(c("x"), c("y"), c("w"), c("h"), c("width"), c("height")))


def resized_boxes(annotations: DataFrame, side: int = 640) -> DataFrame:
    """annotations as bx, by, bw, bh on the image squeezed to a square, clamped to it; those left empty go."""
    sx, sy = F.lit(float(side)) / F.col("width"), F.lit(float(side)) / F.col("height")
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(float(side))))
    rows = annotations.withColumns({"_x1": clamp(F.col("x") * sx), "_y1": clamp(F.col("y") * sy), "_x2": clamp((F.col("x") + F.col("w")) * sx), "_y2": clamp((F.col("y") + F.col("h")) * sy)})
    rows = rows.filter("_x2 > _x1 AND _y2 > _y1")
    return rows.withColumns({"bx": F.col("_x1"), "by": F.col("_y1"), "bw": F.col("_x2") - F.col("_x1"), "bh": F.col("_y2") - F.col("_y1")}).drop("_x1", "_y1", "_x2", "_y2")


def baseline_labels(resized: DataFrame, side: int = 640) -> DataFrame:
    """resized_boxes with cls (category_id - 1) and cx, cy, nw, nh."""
    c = F.col
    return resized.withColumns({"cls": (c("category_id") - 1).cast("int"), "cx": (c("bx") + c("bw") / 2) / side, "cy": (c("by") + c("bh") / 2) / side, "nw": c("bw") / side, "nh": c("bh") / side})


def class_index(categories: DataFrame) -> DataFrame:
    """categories with cls, their place by id. Classes are few, so one window orders them."""
    return categories.withColumn("cls", F.row_number().over(W.orderBy("id")) - 1)


def label_lines(rows: DataFrame, keys: tuple[str, ...], order: str, cls: str = "cls", box: tuple[str, str, str, str] = ("cx", "cy", "bw", "bh")) -> DataFrame:
    """One text for each key: a line for each box in order."""
    line = F.format_string(LINE, F.col(cls).cast("int"), *[F.col(c) for c in box])
    one = F.struct(F.col(order).alias("o"), line.alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["line"]), "\n").alias("text"))


def corners_of(labels: DataFrame) -> DataFrame:
    """cx, cy, w, h as x1, y1, x2, y2."""
    c = F.col
    return labels.withColumns({"x1": c("cx") - c("w") / 2, "y1": c("cy") - c("h") / 2, "x2": c("cx") + c("w") / 2, "y2": c("cy") + c("h") / 2})


def to_coco(labels: DataFrame, images: DataFrame, n_classes: int) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a split from label rows (file_name, line_no, cls, cx, cy, w, h) and images (file_name, width, height).

    Images are numbered by name from 1, also those whose size is null, which have no annotations. Boxes are clamped to the image; empty ones go.
    A class beyond the known ones is its own category.
    """
    numbered = prefix.numbered(images, ["file_name"], "id").withColumn("id", F.col("id").cast("int"))
    own = labels.join(numbered.filter("width > 0 AND height > 0"), "file_name")
    c = F.col
    x = F.greatest(F.lit(0.0), F.least((c("cx") - c("w") / 2) * c("width"), c("width").cast("double")))
    y = F.greatest(F.lit(0.0), F.least((c("cy") - c("h") / 2) * c("height"), c("height").cast("double")))
    own = own.select(c("id").alias("image_id"), "line_no", "cls", x.alias("x"), y.alias("y"), F.least(c("w") * c("width"), c("width") - x).alias("bw"), F.least(c("h") * c("height"), c("height") - y).alias("bh")).filter("bw > 0 AND bh > 0")
    category = F.when(c("cls") < n_classes, c("cls") + 1).otherwise(c("cls"))
    out = prefix.numbered(own, ["image_id", "line_no"], "id")
    return numbered, out.select("id", "image_id", category.alias("category_id"), "x", "y", "bw", "bh", (c("bw") * c("bh")).alias("area"))


def original_stem(name: Column) -> Column:
    """The image a tile's or full image's sample came from."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = F.regexp_extract(stem, r"^(.+)_tile_\d+_\d+$", 1)
    return F.when(stem.endswith("_fi"), F.regexp_replace(stem, "_fi$", "")).when(found != "", found).otherwise(stem)


def kept_per_image(images: DataFrame, annotations: DataFrame, kept: DataFrame) -> DataFrame:
    """For each image: annotations_original, annotations_kept (distinct ones in at least one tile), annotations_discarded."""
    n = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("annotations_original"))
    k = kept.groupBy("image_id").agg(F.countDistinct("ann_id").alias("annotations_kept"))
    own = images.select("image_id").join(n, "image_id", "left").join(k, "image_id", "left").fillna(0)
    return own.withColumn("annotations_discarded", F.col("annotations_original") - F.col("annotations_kept"))


def fold_members(samples: DataFrame, name: str = "sample_name") -> DataFrame:
    """Original stems of a fold's split, each once."""
    return samples.select("split_fold", "split", original_stem(F.col(name)).alias("stem")).distinct()
