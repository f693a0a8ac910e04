"""The service's requests as functions that return tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import cleaning, inference, reconstruct, reports, splits, tiling, validation


def validate_dataset(images: DataFrame, annotations: DataFrame, categories: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status, findings)."""
    found = validation.findings(images, annotations, categories, files)
    return validation.status(found), found


def clean_dataset(images: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    return cleaning.simple_clean(images, annotations, files)


def slice_image(images: DataFrame, image_id: int, t: tiling.Tiling) -> DataFrame:
    """Tiles of one image, which must be at least as large as a tile."""
    own = tiling.large_enough(images.filter(F.col("image_id") == image_id), t.tile)
    if not own.limit(1).count():
        raise ValueError(f"image {image_id} is unknown or smaller than a tile")
    return tiling.tile_names(tiling.tiles(own, t))


def slice_dataset(images: DataFrame, t: tiling.Tiling) -> tuple[DataFrame, DataFrame]:
    """(tiles, totals by image), whatever the images' size."""
    tiled = tiling.tile_names(tiling.tiles(images, t))
    return tiled, reports.tile_totals(tiled)


def infer_dataset(images: DataFrame, t: tiling.Tiling, engine, **settings) -> tuple[DataFrame, DataFrame]:
    """(final detections, summary by image)."""
    raw, final = inference.infer(images, tiling.tiles(images, t), engine, **settings)
    return final, inference.summary(images, raw, final)


def choose_image(images: DataFrame, file_name: str | None = None, seed: int = 0) -> DataFrame:
    """One row of images: that of this name, or any one where none is named. A name with a folder, or that no image has, is an error."""
    if file_name is None:
        return splits.random_image(images, seed)
    found = images.filter(F.col("file_name") == file_name)
    if "/" in file_name or not found.limit(1).count():
        raise ValueError(f"no image {file_name!r} in the dataset")
    return found


def infer_image(images: DataFrame, t: tiling.Tiling, engine, file_name: str | None = None, seed: int = 0, **settings) -> tuple[DataFrame, DataFrame]:
    """(final detections, summary) of one image, named or drawn (see choose_image); tiles alone, or the whole image too where the mode has it so."""
    own = choose_image(images, file_name, seed)
    settings.setdefault("whole", inference.with_full_image(t.mode))
    raw, final = inference.infer(own, tiling.tiles(own, t), engine, **settings)
    return final, inference.summary(own, raw, final)


def infer_dataset_captured(images: DataFrame, t: tiling.Tiling, load, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final detections, summary of the images processed, failures: image_id and error). One image that fails leaves all others as they are."""
    raw, final, outcome = inference.infer_captured(images, tiling.tiles(images, t), load, **settings)
    return final, inference.summary(images.join(outcome.done, "image_id", "left_semi"), raw, final), outcome.failures


def rebuild_image(tiles: DataFrame) -> DataFrame:
    return reconstruct.rebuild(tiles)


def validate_rebuilt(originals: DataFrame, tiles: DataFrame) -> DataFrame:
    return reconstruct.mismatches(originals, reconstruct.rebuild(tiles))
