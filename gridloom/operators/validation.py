"""Integrity rules as tables of findings (severity, rule, subject)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _found(df: DataFrame, severity: str, rule: str, subject) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))


def _repeated(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")


def findings(images: DataFrame, annotations: DataFrame, categories: DataFrame, files: DataFrame) -> DataFrame:
    """Every finding on an annotation set. An annotation of an unknown image, or with a malformed box, has no further findings; images without a file
    count as unknown."""
    out = [
        _found(_repeated(categories, "id"), "error", "duplicate_category", F.col("id")),
        _found(categories.filter("name IS NULL OR trim(name) = ''"), "error", "nameless_category", F.col("id")),
        _found(_repeated(images, "id"), "error", "duplicate_image", F.col("id")),
        _found(images.filter("file_name IS NULL OR file_name = ''"), "error", "nameless_image", F.col("id")),
        _found(images.filter("file_name <> ''").join(files.select("file_name"), "file_name", "left_anti"), "error", "missing_file", F.col("file_name")),
        _found(images.filter("coalesce(width, 0) = 0 OR coalesce(height, 0) = 0"), "warning", "no_dimensions", F.col("id")),
        _found(files.join(images.select("file_name"), "file_name", "left_anti"), "warning", "orphan_file", F.col("file_name")),
        _found(_repeated(annotations, "id"), "error", "duplicate_annotation", F.col("id")),
    ]
    known = images.join(files.select("file_name").distinct(), "file_name", "left_semi").select(F.col("id").alias("image_id"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.lit(True).alias("_known")).dropDuplicates(["image_id"])
    kinds = F.broadcast(categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_kind")).distinct())
    own = annotations.join(known, "image_id", "left").join(kinds, "category_id", "left")
    lone, four = F.col("_known").isNull(), F.coalesce(F.size("bbox") == 4, F.lit(False))
    x, y, w, h = (F.when(four, F.get("bbox", F.lit(i))) for i in range(4))
    further = ~lone & four
    sized = (F.coalesce(F.col("_w"), F.lit(0)) > 0) & (F.coalesce(F.col("_h"), F.lit(0)) > 0)
    rules = [
        ("error", "unknown_image", lone), ("error", "unknown_category", ~lone & F.col("_kind").isNull()), ("error", "malformed_bbox", ~lone & ~four),
        ("error", "empty_bbox", further & ((w <= 0) | (h <= 0))), ("warning", "negative_origin", further & ((x < 0) | (y < 0))),
        ("warning", "out_of_bounds", further & sized & ((x + w > F.col("_w")) | (y + h > F.col("_h")))),
        ("warning", "area_mismatch", further & F.col("area").isNotNull() & (F.abs(F.col("area") - w * h) > 1.0)),
    ]
    flags = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, c in rules]), lambda f: f.isNotNull())
    rows = own.select("id", F.explode(flags).alias("f"))
    out.append(rows.select("f.severity", "f.rule", F.col("id").cast("string").alias("subject")))
    return reduce(DataFrame.unionByName, out)


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n_findings"))


def status(found: DataFrame) -> DataFrame:
    """One row: errors, warnings or ok."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    return found.agg(F.when(n("error") > 0, "errors").when(n("warning") > 0, "warnings").otherwise("ok").alias("status"), n("error").alias("errors"), n("warning").alias("warnings"))


def generated(images: DataFrame, annotations: DataFrame, files: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Findings on a written split (annotations with flat x, y, w, h): missing files, unknown images, negative, empty or oversized boxes."""
    out = [_found(images.join(files.select("file_name"), "file_name", "left_anti"), "error", "missing_file", F.col("file_name"))]
    own = annotations.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id", "left")
    bad = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") <= 0) | (F.col("h") <= 0)
    wide = (F.col("x") + F.col("w") > F.col("width") + tolerance) | (F.col("y") + F.col("h") > F.col("height") + tolerance)
    out += [_found(own.filter(c), "error", r, F.col("id")) for r, c in (("unknown_image", F.col("width").isNull()), ("bad_bbox", bad), ("out_of_bounds", wide))]
    return reduce(DataFrame.unionByName, out)


def differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of one side only: side and value. Empty when both sets are equal."""
    a, b = (d.select(F.col(column).cast("string").alias("value")).distinct() for d in (left, right))
    return a.join(b, "value", "left_anti").select(F.lit("left").alias("side"), "value").unionByName(b.join(a, "value", "left_anti").select(F.lit("right").alias("side"), "value"))
