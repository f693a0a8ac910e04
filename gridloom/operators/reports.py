"""Reports over per-image metrics, and what a run will need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .labels import original_stem
from .tiling import Tiling, geometry

#: Bytes of a compressed pixel triple as a share, and of a label file.
JPEG_SHARE, LABEL_BYTES = 0.08, 512
SPLIT_ORDER = {"train": 0, "val": 1, "test": 2}


def first_seen(metrics: DataFrame) -> DataFrame:
    """One row for each image_name: the first by fold, then train, val, test."""
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    own = W.partitionBy("image_name").orderBy("fold", rank)
    return metrics.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def resolution_groups(metrics: DataFrame, t: Tiling) -> DataFrame:
    """Unique images of each resolution with its grid. Grids are worked out once for each resolution."""
    n = first_seen(metrics).groupBy("width", "height").agg(F.count(F.lit(1)).alias("image_count"))
    return geometry(n, t).withColumn("resolution", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))


def fold_summary(metrics: DataFrame) -> DataFrame:
    """For each fold: images of each split, tiles, annotations discarded, and the mean slicing time over all splits (0 without images)."""
    n = [F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in SPLIT_ORDER]
    return metrics.groupBy("fold").agg(*n, F.sum("tiles_generated").alias("tiles"), F.sum("annotations_discarded").alias("annotations_discarded"), F.coalesce(F.avg("slicing_time_ms"), F.lit(0.0)).alias("mean_slicing_time_ms"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """One row over unique images; only tiles are counted over all folds, also in tiles by image."""
    own = first_seen(metrics).agg(
        F.count(F.lit(1)).alias("original_images"), F.sum("annotations_original").alias("original_annotations"), F.sum("annotations_discarded").alias("discarded"),
        F.sum("empty_tiles_kept").alias("empty_tiles_kept"), F.sum("empty_tiles_discarded").alias("empty_tiles_discarded"),
        F.avg("slicing_time_ms").alias("mean_time_ms"), F.stddev_pop("slicing_time_ms").alias("std_time_ms"),
    )
    own = own.crossJoin(metrics.agg(F.sum("tiles_generated").alias("tiles_all_folds")))
    rate = F.when(F.coalesce(F.col("original_annotations"), F.lit(0)) > 0, F.col("discarded") / F.col("original_annotations") * 100).otherwise(F.lit(0.0))
    return own.withColumns({"mean_tiles_per_image": F.try_divide("tiles_all_folds", "original_images"), "discard_rate_pct": rate, "kept_annotations": F.col("original_annotations") - F.col("discarded")})


def slicing_times(metrics: DataFrame) -> DataFrame:
    """Mean and total slicing time of each fold's test images."""
    return metrics.filter("split = 'test'").groupBy("fold").agg(F.avg("slicing_time_ms").alias("slicing_time_ms_mean"), F.sum("slicing_time_ms").alias("slicing_time_ms_total"))


def disk_estimate(resolutions: DataFrame, t: Tiling, folds: int, val_ratio: float, test_ratio: float | None = None, strategy: str = "kfold_holdout", source_bytes: int = 0) -> DataFrame:
    """One row, gigabytes: resolutions have n_images. Every training image counts as its tiles and one full-image sample in each fold it trains in."""
    if strategy == "fixed_ratios":
        test = 1 / folds if test_ratio is None else test_ratio
        train, held = folds * (1 - val_ratio - test), folds * (val_ratio + test)
    else:
        train, held = (folds - 1) * (1 - val_ratio), 1 + (folds - 1) * val_ratio
    each = int(t.tile[0] * t.tile[1] * 3 * JPEG_SHARE) + LABEL_BYTES
    samples = F.coalesce(F.sum(F.col("n_images") * (F.col("tiles_per_image") + 1)), F.lit(0))
    return geometry(resolutions, t).agg(((samples * train * each + source_bytes * held) / 1e9).alias("gigabytes"))


def rebuilt_counts(samples: DataFrame) -> DataFrame:
    """From label files (sample_name, text): for each original stem its tiles and the label lines over all of them (boxes in two tiles count twice)."""
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    rows = samples.filter(F.col("sample_name").rlike(r"_tile_\d+_\d+(\.[^.]*)?$"))
    return rows.select(original_stem(F.col("sample_name")).alias("stem"), lines.alias("n")).groupBy("stem").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("annotations_kept"))


def tile_totals(tiled: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return tiled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tiles"), F.sum(F.col("tile_width").cast("long") * F.col("tile_height")).alias("tile_pixels"))
