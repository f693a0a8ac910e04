"""Tilings of images as row generators.

A mode names a grid: "sahi" has square tiles of fixed size at a fixed stride, anchored at the far edge; "asahi" a 4x3 or 3x2 grid of equal
tiles chosen by the long side; "asahi_rect" a grid of nearly square ones; "none" no tiles. An unknown mode means "sahi". Grids depend on the
resolution alone, so each operator works out positions once per row in codegen'd arithmetic; nothing shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the side that the adaptive threshold is worked out from, whatever the tile size.
REFERENCE_SIDE = 640


@dataclass(frozen=True)
class Tiling:
    mode: str = "sahi"
    overlap: float = 0.15
    tile: tuple[int, int] = (640, 640)

    @property
    def kind(self) -> str:
        return self.mode if self.mode in ("asahi", "asahi_rect", "none") else "sahi"

    @property
    def stride(self) -> tuple[int, int]:
        return tuple(max(1, t - int(t * self.overlap)) for t in self.tile)

    @property
    def threshold(self) -> float:
        return REFERENCE_SIDE * (4 - 3 * self.overlap) + 1


def _long(t: Tiling, w: Column, h: Column) -> Column:
    return F.when(F.greatest(w, h) > t.threshold, 4).otherwise(3)


def grid(t: Tiling, w: Column, h: Column) -> tuple[Column, Column]:
    """Columns and rows of an adaptive grid."""
    long = _long(t, w, h)
    if t.kind == "asahi":
        short = long - 1
    else:
        short = F.greatest(F.lit(1), F.bround(long * F.least(w, h) / F.greatest(w, h)).cast("int"))
    return F.when(w >= h, long).otherwise(short), F.when(w >= h, short).otherwise(long)


def _side(t: Tiling, size: Column, n: Column) -> Column:
    """Length of a tile along an axis that n of them share."""
    share = size / (n - (n - 1) * t.overlap)
    return F.least(F.ceil(share + 1 if t.kind == "asahi" else share), size).cast("int")


def tile_size(t: Tiling, w: Column, h: Column) -> tuple[Column, Column]:
    if t.kind in ("sahi", "none"):
        return F.lit(t.tile[0]), F.lit(t.tile[1])
    cols, rows = grid(t, w, h)
    return _side(t, w, cols), _side(t, h, rows)


def positions(t: Tiling, w: Column, h: Column) -> tuple[Column, Column]:
    """Arrays of tile starts along x and y."""
    if t.kind == "none":
        none = F.expr("cast(array() as array<int>)")
        return none, none
    if t.kind == "sahi":
        out = []
        for size, tile, stride in zip((w, h), t.tile, t.stride, strict=True):
            last = F.greatest(size - tile, F.lit(0)).cast("int")
            out.append(F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))))
        return tuple(out)
    out = []
    for size, n, tile in zip((w, h), grid(t, w, h), tile_size(t, w, h), strict=True):
        out.append(F.transform(F.sequence(F.lit(0), n - 1), _spread(size - tile, F.greatest(n - 1, F.lit(1)))))
    return tuple(out)


def _spread(room: Column, steps: Column):
    return lambda i: F.bround(i * room / steps).cast("int")


def tiles(images: DataFrame, t: Tiling) -> DataFrame:
    """A row for each tile, row by row: the columns of images (with width and height) and row_index, column_index, x, y, tile_width, tile_height.

    Fixed-size tiles are clipped to the image, adaptive ones never exceed it. Images without a size give no tiles.
    """
    w, h = F.col("width"), F.col("height")
    xs, ys = positions(t, w, h)
    tw, th = tile_size(t, w, h)
    own = images.columns
    rows = images.filter((w > 0) & (h > 0)).select(*own, tw.alias("tile_width"), th.alias("tile_height"), xs.alias("xs"), F.posexplode(ys).alias("row_index", "y"))
    rows = rows.select(*own, "tile_width", "tile_height", "row_index", "y", F.posexplode("xs").alias("column_index", "x"))
    if t.kind == "sahi":
        rows = rows.withColumns({"tile_width": F.least("tile_width", w - F.col("x")), "tile_height": F.least("tile_height", h - F.col("y"))})
    return rows.select(*own, "row_index", "column_index", "x", "y", "tile_width", "tile_height")


def _touched(t: Tiling, size: Column, tile: Column, n: Column, start: Column, end: Column) -> Column:
    """Array of (i, at): the tiles of an axis, their place among n and their start, that an interval can touch. The inverse of the positions, so its length follows
    from the interval, not from n; rounded positions may add one at either end."""
    if t.kind == "sahi":
        last = F.greatest(size - tile, F.lit(0)).cast("int")
        stride = n  # fixed tiles are placed by their stride, not by their number
        low, high = F.floor((start - tile) / stride) + 1, F.when(end > last, F.ceil(last / stride)).otherwise(F.ceil(end / stride) - 1)
        top, at = F.ceil(last / stride), lambda i: F.least(i * stride, last).cast("int")
    else:
        room, steps = size - tile, F.greatest(n - 1, F.lit(1))
        low = F.when(room > 0, F.floor((start - tile - 0.5) * steps / room) + 1).otherwise(0)
        high = F.when(room > 0, F.ceil((end + 0.5) * steps / room) - 1).otherwise(n - 1)
        top, at = n - 1, _spread(room, steps)
    low, high = F.greatest(low, F.lit(0)).cast("int"), F.least(high, top).cast("int")
    low = F.least(low, top.cast("int"))
    every = F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(every, lambda i: F.struct(i.cast("int").alias("i"), at(i).alias("at")))


def touched_tiles(boxes: DataFrame, t: Tiling) -> DataFrame:
    """boxes (x, y, w, h, and width and height of their image) with a row for each tile of their image that they can touch: row_index, column_index, tile_x, tile_y,
    tile_width, tile_height. The tiles follow from the box and the grid by arithmetic: no table of tiles, no join, and none far from a box. Boxes of images without a
    size, and all where there are no tiles, have no row."""
    w, h, c = F.col("width"), F.col("height"), F.col
    if t.kind == "none":
        rows, (tw, th), (nx, ny) = boxes.limit(0), tile_size(t, w, h), (F.lit(1), F.lit(1))
    else:
        rows, (tw, th) = boxes.filter((w > 0) & (h > 0)), tile_size(t, w, h)
        nx, ny = map(F.lit, t.stride) if t.kind == "sahi" else grid(t, w, h)
    own = boxes.columns
    rows = rows.select(*own, tw.alias("_tw"), th.alias("_th"), nx.alias("_nx"), ny.alias("_ny"))
    rows = rows.withColumn("_row", F.explode(_touched(t, h, c("_th"), c("_ny"), c("y"), c("y") + c("h"))))
    rows = rows.withColumn("_column", F.explode(_touched(t, w, c("_tw"), c("_nx"), c("x"), c("x") + c("w"))))
    x, y = c("_column.at"), c("_row.at")
    tw, th = (F.least("_tw", w - x), F.least("_th", h - y)) if t.kind in ("sahi", "none") else (c("_tw"), c("_th"))
    return rows.select(*own, c("_row.i").alias("row_index"), c("_column.i").alias("column_index"), x.alias("tile_x"), y.alias("tile_y"), tw.alias("tile_width"), th.alias("tile_height"))


def tile_names(tiled: DataFrame, file_name: str = "file_name") -> DataFrame:
    """tiled and tile_file, the name of each tile's file."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return tiled.withColumn("tile_file", F.format_string("%s_tile_%d_%d.jpg", stem, "x", "y"))


def geometry(resolutions: DataFrame, t: Tiling) -> DataFrame:
    """resolutions (width, height and more) and tile_size_p, cols, rows, tiles_per_image, redundant_pixels, redundancy_pct (2 digits).

    A fixed tile counts with its nominal area even where it is clipped.
    """
    w, h = F.col("width"), F.col("height")
    if t.kind == "none":
        zero = F.lit(0).cast("long")
        return resolutions.select("*", F.lit("none").alias("tile_size_p"), F.lit(0).alias("cols"), F.lit(0).alias("rows"), F.lit(0).alias("tiles_per_image"), zero.alias("redundant_pixels"), F.lit(0.0).alias("redundancy_pct"))
    xs, ys = positions(t, w, h)
    tw, th = tile_size(t, w, h)
    name = F.lit(str(t.tile[0])) if t.kind == "sahi" else F.concat_ws("x", tw.cast("string"), th.cast("string"))
    rows = resolutions.select("*", name.alias("tile_size_p"), F.size(xs).alias("cols"), F.size(ys).alias("rows"), (tw.cast("long") * th).alias("_area"))
    more = F.greatest(F.lit(0).cast("long"), F.col("cols") * F.col("rows") * F.col("_area") - w.cast("long") * h)
    rows = rows.withColumns({"tiles_per_image": F.col("cols") * F.col("rows"), "redundant_pixels": more})
    return rows.withColumn("redundancy_pct", F.bround(F.col("redundant_pixels") / (w.cast("long") * h) * 100, 2)).drop("_area")


def edge_coverage(tiled: DataFrame, t: Tiling, keys: list[str]) -> DataFrame:
    """For each image and axis with two or more positions: how the last tile overlaps the one before it."""
    parts = []
    for axis, tile, stride in zip("xy", t.tile, t.stride, strict=True):
        at = tiled.groupBy(*keys).agg(F.array_sort(F.collect_set(axis)).alias("p")).filter(F.size("p") >= 2)
        last, before = F.element_at("p", -1), F.element_at("p", -2)
        at = at.select(*keys, F.lit(axis).alias("axis"), before.alias("last_regular_position"), last.alias("anchor_position"), (last - before).alias("gap_px"))
        nominal, actual = F.lit(tile - stride), F.lit(tile) - F.col("gap_px")
        parts.append(at.select("*", nominal.alias("nominal_overlap_px"), actual.alias("actual_overlap_px"), (actual - nominal).alias("extra_overlap_px"), (actual > nominal).alias("has_extra")))
    return parts[0].unionByName(parts[1])


def overlap_metadata(tiled: DataFrame, t: Tiling) -> DataFrame:
    """tiled and the nominal tile size and overlap in pixels."""
    over = [a - b for a, b in zip(t.tile, t.stride, strict=True)]
    return tiled.withColumns({"tile_size": F.array(*map(F.lit, t.tile)), "overlap_px": F.array(*map(F.lit, over))})


def tile_overlaps(tiled: DataFrame, key: str = "image_id") -> DataFrame:
    """Common rectangles of each image's pairs of tiles, the earlier one first; an equi-join on the image with interval bounds."""
    number = F.row_number().over(W.partitionBy(key).orderBy("row_index", "column_index"))
    box = lambda p: tiled.select(key, number.alias(f"{p}tile"), F.col("x").alias(f"{p}x1"), F.col("y").alias(f"{p}y1"), (F.col("x") + F.col("tile_width")).alias(f"{p}x2"), (F.col("y") + F.col("tile_height")).alias(f"{p}y2"))
    both = box("a_").join(box("b_"), key).filter("a_tile < b_tile AND a_x1 < b_x2 AND b_x1 < a_x2 AND a_y1 < b_y2 AND b_y1 < a_y2")
    return both.select(key, "a_tile", "b_tile", F.greatest("a_x1", "b_x1").alias("x1"), F.greatest("a_y1", "b_y1").alias("y1"), F.least("a_x2", "b_x2").alias("x2"), F.least("a_y2", "b_y2").alias("y2"))


def coverage(tiled: DataFrame, key: str = "image_id") -> DataFrame:
    """Cells between the distinct tile edges of an image and how many tiles cover each; cells stand for their pixels, so no pixel is a row."""
    def cuts(a: str, size: str) -> Column:
        both = F.array_sort(F.array_distinct(F.concat(F.collect_set(a), F.collect_set(F.col(a) + F.col(size)))))
        return F.transform(F.slice(both, 1, F.size(both) - 1), lambda s, i: F.struct(s.alias("a"), F.element_at(both, i + 2).alias("b")))

    edges = tiled.groupBy(key).agg(cuts("x", "tile_width").alias("xs"), cuts("y", "tile_height").alias("ys"))
    cells = edges.select(key, "ys", F.explode("xs").alias("cx")).select(key, "cx", F.explode("ys").alias("cy"))
    cells = cells.select(key, F.col("cx.a").alias("cx1"), F.col("cx.b").alias("cx2"), F.col("cy.a").alias("cy1"), F.col("cy.b").alias("cy2"))
    inside = (F.col("x") <= F.col("cx1")) & (F.col("cx2") <= F.col("x") + F.col("tile_width")) & (F.col("y") <= F.col("cy1")) & (F.col("cy2") <= F.col("y") + F.col("tile_height"))
    own = tiled.select(key, "x", "y", "tile_width", "tile_height")
    found = cells.join(own, key).filter(inside)
    return found.groupBy(key, "cx1", "cy1", "cx2", "cy2").agg(F.count(F.lit(1)).alias("tiles"))


def coverage_stats(tiled: DataFrame, key: str = "image_id") -> DataFrame:
    """Mean, population standard deviation, least and most tiles over an image's covered pixels, and their number."""
    area = (F.col("cx2") - F.col("cx1")).cast("long") * (F.col("cy2") - F.col("cy1"))
    rows = coverage(tiled, key).select(key, "tiles", area.alias("area"))
    n, s, q = F.sum("area"), F.sum(F.col("tiles") * F.col("area")), F.sum(F.col("tiles") * F.col("tiles") * F.col("area"))
    return rows.groupBy(key).agg(n.alias("pixels"), (s / n).alias("mean_tiles"), F.sqrt(F.greatest(q / n - s / n * (s / n), F.lit(0.0))).alias("std_tiles"), F.min("tiles").alias("min_tiles"), F.max("tiles").alias("max_tiles"))


def letterbox(w: Column, h: Column, target: tuple[int, int] = (640, 640)) -> dict[str, Column]:
    """scale, pad_x and pad_y that fit a w x h picture into the target, centred."""
    scale = F.least(F.lit(float(target[0])) / w, F.lit(float(target[1])) / h)
    pad = lambda t, size: F.floor((F.lit(t) - (size * scale).cast("int")) / 2).cast("int")
    return {"scale": scale, "pad_x": pad(target[0], w), "pad_y": pad(target[1], h)}


def large_enough(images: DataFrame, tile: tuple[int, int] = (640, 640)) -> DataFrame:
    """Images that are at least as wide and high as a tile."""
    return images.filter((F.col("width") >= tile[0]) & (F.col("height") >= tile[1]))


def resolution_histogram(images: DataFrame) -> DataFrame:
    """Images of each resolution; those without one (null or 0) don't count."""
    return images.filter("width > 0 AND height > 0").groupBy("width", "height").agg(F.count(F.lit(1)).alias("n_images"))


def position_gaps(tiled: DataFrame, key: str = "image_id", axis: str = "x") -> DataFrame:
    """Distances of neighbouring tile positions along an axis."""
    at = tiled.select(key, F.col(axis).alias("position")).distinct()
    gap = F.col("position") - F.lag("position").over(W.partitionBy(key).orderBy("position"))
    return at.select(key, "position", gap.alias("gap")).filter("gap IS NOT NULL")
