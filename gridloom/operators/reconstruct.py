"""Images from their tiles."""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import boxes
from ..sources import files

#: Bytes of an image that one group puts together.
STRIP_BYTES = 4 << 20


def _rows(strip_bytes: int):
    return F.greatest(F.floor(F.lit(strip_bytes) / (3 * F.col("width"))), F.lit(1)).cast("int")


def _cut(tiles: DataFrame, strip_bytes: int) -> DataFrame:
    """image_id, width, height, rows, strip, x, y (within the strip), tile_width, pixels: tiles cut into the rows that each strip needs."""
    rows = _rows(strip_bytes)
    own = tiles.select("image_id", "width", "height", "x", "y", "tile_width", "tile_height", "pixels").withColumn("rows", rows)
    end = F.least(F.col("y") + F.col("tile_height"), F.col("height"))
    inside = own.filter((F.col("y") < F.col("height")) & (F.col("x") < F.col("width")) & (F.col("tile_height") > 0) & (F.col("tile_width") > 0))
    met = inside.withColumn("end", end).withColumn("strip", F.explode(F.sequence(F.floor(F.col("y") / F.col("rows")).cast("int"), F.floor((F.col("end") - 1) / F.col("rows")).cast("int"))))
    first = F.greatest(F.col("y"), F.col("strip") * F.col("rows"))
    count = F.least(F.col("end"), (F.col("strip") + 1) * F.col("rows")) - first
    line = 3 * F.col("tile_width")
    return met.select("image_id", "width", "height", "rows", "strip", "x", (first - F.col("strip") * F.col("rows")).alias("y"), "tile_width", F.substring("pixels", (first - F.col("y")) * line + 1, count * line).alias("pixels"))


def _joined(batches):
    """(image_id, width, height, rows, strip, pixels) of each strip of batches sorted by image_id and strip; a strip is put together alone."""
    for rows, first in boxes.whole_groups(batches, ["image_id", "strip"]):
        of, x, y, wide, data = (rows.column(c).to_pylist() for c in ("image_id", "x", "y", "tile_width", "pixels"))
        width, height, each, strip = (rows.column(c).to_pylist() for c in ("width", "height", "rows", "strip"))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), rows.num_rows], strict=True):
            w, h = width[i], min(each[i], height[i] - strip[i] * each[i])
            total, seen = np.zeros((h, w, 3)), np.zeros((h, w, 1))
            for k in range(i, j):
                part = np.frombuffer(data[k], np.uint8).reshape(-1, wide[k], 3)[:, : w - x[k]]
                total[y[k] : y[k] + len(part), x[k] : x[k] + part.shape[1]] += part
                seen[y[k] : y[k] + len(part), x[k] : x[k] + part.shape[1]] += 1
            yield of[i], w, height[i], each[i], strip[i], (total / np.maximum(seen, 1)).astype(np.uint8).tobytes()


def _batched(rows, kind: T.StructType):
    arrow = to_arrow_schema(kind)
    yield from files.batched(rows, arrow.names, arrow.types, lambda r: len(r[-1]))


def strips(tiles: DataFrame, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """image_id, width, height, strip (from 0), pixels: the images in strips of whole rows, as many rows as strip_bytes hold (one at least), from tiles (those columns, x, y,
    tile_width, tile_height, pixels: rows of three bytes). Each pixel is the mean of the tiles over it, cut to a whole number, 0 where there is none.

    A tile is cut into the rows that each strip needs before anything moves, so a strip is one group. Parts of tiles beyond the image go; strips without
    a tile have no row. Repeated tiles count as often as they come."""
    kind = tiles.select("image_id").schema.add("width", "integer").add("height", "integer").add("strip", "integer").add("pixels", "binary")
    run = lambda batches: _batched(((i, w, h, s, p) for i, w, h, _, s, p in _joined(batches)), kind)
    return _cut(tiles, strip_bytes).repartition("image_id", "strip").sortWithinPartitions("image_id", "strip").mapInArrow(run, kind)


def rebuild(tiles: DataFrame, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """image_id, width, height, pixels: the strips of each image one after another (see strips), zeros for those without a tile. Images that no tile touches have no row.

    An image ends as one value, so its strips are dealt to one task, which puts them together one by one, and pixels move once."""
    kind = tiles.select("image_id").schema.add("width", "integer").add("height", "integer").add("pixels", "binary")

    def whole(batches):
        for (i, w, h, rows), own in groupby(_joined(batches), lambda r: r[:4]):
            parts, done = [], 0
            for *_, strip, pixels in own:
                parts += [bytes(3 * w * rows * (strip - done)), pixels]
                done = strip + 1
            yield i, w, h, b"".join([*parts, bytes(3 * w * max(h - done * rows, 0))])

    return _cut(tiles, strip_bytes).repartition("image_id").sortWithinPartitions("image_id", "strip").mapInArrow(lambda batches: _batched(whole(batches), kind), kind)


def mismatches(originals: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Images whose pixels differ from the original's, or that were not rebuilt. originals: image_id and pixels, or sha (their SHA-256 in hexadecimal); only digests move."""
    own = originals.select("image_id", F.col("sha") if "sha" in originals.columns else F.sha2("pixels", 256).alias("sha"))
    other = rebuilt.select("image_id", F.sha2("pixels", 256).alias("_sha"))
    return own.join(other, "image_id", "left").filter(F.col("_sha").isNull() | (F.col("_sha") != F.col("sha"))).select("image_id")
