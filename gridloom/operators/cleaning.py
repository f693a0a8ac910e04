"""Cleaning of annotation tables.

images: id, file_name, width, height. annotations: id, image_id, category_id, bbox (x, y, w, h in pixels), area. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REASONS = ("unknown_image", "unknown_category", "malformed_bbox", "degenerate_bbox")


def existing(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images whose file is in the listing."""
    return images.join(files.select("file_name").distinct(), "file_name", "left_semi")


def missing(images: DataFrame, files: DataFrame) -> DataFrame:
    return images.join(files.select("file_name"), "file_name", "left_anti")


def orphans(images: DataFrame, files: DataFrame) -> DataFrame:
    """Files that no image names."""
    return files.join(images.select("file_name"), "file_name", "left_anti")


def filled(images: DataFrame, decoded: DataFrame) -> DataFrame:
    """Sizes from the decoded files (file_name, disk_width, disk_height) where they are null or 0."""
    own = images.join(decoded.select("file_name", "disk_width", "disk_height"), "file_name", "left")
    pick = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.col(f"disk_{c}"))
    return own.withColumns({"width": pick("width"), "height": pick("height")}).select(*images.columns)


def examined(images: DataFrame, annotations: DataFrame, categories: DataFrame | None) -> DataFrame:
    """annotations with x, y, w, h after clamping to the image, clamped, area, area_fixed and reason: the first of REASONS, or null.

    Boxes are clamped only where the image has a size. A declared area stays if it is within 1 of the box's.
    """
    known = images.select(F.col("id").alias("image_id"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.lit(True).alias("_image")).dropDuplicates(["image_id"])
    own = annotations.join(known, "image_id", "left")
    if categories is not None:  # as many as there are classes
        own = own.join(F.broadcast(categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_category")).distinct()), "category_id", "left")
        some = categories.agg((F.count(F.lit(1)) > 0).alias("_some"))
        own = own.crossJoin(F.broadcast(some)).withColumn("_bad", F.col("_some") & F.col("_category").isNull()).drop("_some", "_category")
    else:
        own = own.withColumn("_bad", F.lit(False))
    four = F.size("bbox") == 4
    b = [F.when(four, F.get("bbox", F.lit(i))) for i in range(4)]
    sized = (F.coalesce(F.col("_w"), F.lit(0)) > 0) & (F.coalesce(F.col("_h"), F.lit(0)) > 0)
    own = own.withColumns({"_x": b[0], "_y": b[1], "_bw": b[2], "_bh": b[3]})
    within = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top.cast("double")))
    own = own.withColumns({
        "_x1": within(F.col("_x"), F.col("_w")), "_y1": within(F.col("_y"), F.col("_h")),
        "_x2": within(F.col("_x") + F.col("_bw"), F.col("_w")), "_y2": within(F.col("_y") + F.col("_bh"), F.col("_h")),
    })
    pick = lambda a, c: F.when(sized, a).otherwise(F.col(c))
    own = own.withColumns({"x": pick(F.col("_x1"), "_x"), "y": pick(F.col("_y1"), "_y"), "w": pick(F.col("_x2") - F.col("_x1"), "_bw"), "h": pick(F.col("_y2") - F.col("_y1"), "_bh")})
    moved = F.lit(False)
    for a, c in (("x", "_x"), ("y", "_y"), ("w", "_bw"), ("h", "_bh")):
        moved = moved | (F.col(a) != F.col(c))
    reason = (
        F.when(F.col("_image").isNull(), REASONS[0]).when(F.col("_bad"), REASONS[1]).when(~F.coalesce(four, F.lit(False)), REASONS[2])
        .when((F.col("w") <= 0) | (F.col("h") <= 0), REASONS[3])
    )
    own = own.withColumn("reason", reason)
    reached = F.col("reason").isNull() | (F.col("reason") == REASONS[3])
    wrong = F.col("area").isNull() | (F.abs(F.col("area") - F.col("w") * F.col("h")) > 1.0)
    own = own.withColumns({"clamped": reached & sized & moved, "area_fixed": F.col("reason").isNull() & wrong})
    own = own.withColumn("area", F.when(F.col("area_fixed"), F.col("w") * F.col("h")).otherwise(F.col("area")))
    return own.select(*[c for c in own.columns if not c.startswith("_")])


def cleaned(images: DataFrame, annotations: DataFrame, categories: DataFrame | None) -> DataFrame:
    return examined(images, annotations, categories).filter("reason IS NULL").drop("reason", "clamped", "area_fixed")


def annotated(images: DataFrame, clean: DataFrame) -> DataFrame:
    """Images with at least one annotation."""
    return images.join(clean.select(F.col("image_id").alias("id")).distinct(), "id", "left_semi")


def report(seen: DataFrame) -> DataFrame:
    """Counts of an examined table, clamped ones before degenerate boxes are dropped."""
    n = lambda c: F.count(F.when(c, 1))
    return seen.agg(
        F.count(F.lit(1)).alias("total"), n(F.col("reason").isNull()).alias("kept"), *[n(F.col("reason") == r).alias(r) for r in REASONS],
        n(F.col("clamped")).alias("clamped"), n(F.col("area_fixed")).alias("area_fixed"),
    )


def simple_clean(images: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    """images and status: kept, no_file, or no_annotation."""
    on_disk = files.select("file_name", F.lit(True).alias("_file")).distinct()
    used = annotations.select(F.col("image_id").alias("id"), F.lit(True).alias("_used")).distinct()
    own = images.join(on_disk, "file_name", "left").join(used, "id", "left")
    status = F.when(F.col("_file").isNull(), "no_file").when(F.col("_used").isNull(), "no_annotation").otherwise("kept")
    return own.select(*images.columns, status.alias("status"))


def repeated_stems(images: DataFrame) -> DataFrame:
    """File stems that more than one image has; labels could not be told apart."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return images.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n_images")).filter("n_images > 1")


def used_categories(categories: DataFrame, annotations: DataFrame) -> DataFrame:
    return categories.join(annotations.select(F.col("category_id").alias("id")).distinct(), "id", "left_semi")
