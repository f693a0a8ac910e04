"""Images, annotations and detections derived from the part and lineitem tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS image_id", "1280 + 64 * p_size AS width", "720 + 36 * p_size AS height", "p_partkey % 5 AS fold", "concat('img_', p_partkey, '.jpg') AS file_name")


_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the flag parts no lines that differ elsewhere; with it annotations and detections need the same columns, so one shuffle of the lines serves both
    own = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(W.partitionBy("l_partkey").orderBy(*_ORDER, "l_returnflag")))
    return own.join(images(spark, sf_dir).hint("merge"), F.col("l_partkey") == F.col("image_id"))  # lines are dealt and sorted by image already


_ANN = [
    "l_partkey * 1000 + rn AS ann_id", "image_id", "1 + l_linenumber % 3 AS category_id",
    "(l_orderkey * 37 + l_linenumber * 101) % width - 10 AS x", "(l_suppkey * 53 + l_orderkey * 17) % height - 10 AS y",
    "20 + 6 * CAST(l_quantity AS INT) AS w", "20 + 5 * CAST(l_quantity AS INT) AS h", "width", "height", "fold",
]


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(*_ANN)


def dirty_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With unknown images and categories, short boxes, empty boxes and wrong areas."""
    own = annotations(spark, sf_dir)
    return own.selectExpr(
        "ann_id AS id", "CASE WHEN ann_id % 97 = 0 THEN -1 ELSE image_id END AS image_id", "CASE WHEN ann_id % 89 = 0 THEN 99 ELSE category_id END AS category_id",
        "CASE WHEN ann_id % 83 = 0 THEN array(double(x), double(y), double(w)) ELSE array(double(x), double(y), double(CASE WHEN ann_id % 79 = 0 THEN 0 ELSE w END), double(h)) END AS bbox",
        "CASE WHEN ann_id % 7 = 0 THEN NULL WHEN ann_id % 7 = 1 THEN 1.5D ELSE double(w * h) END AS area",
    )


def dirty_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With missing sizes."""
    return images(spark, sf_dir).selectExpr("image_id AS id", "file_name", "CASE WHEN image_id % 41 = 0 THEN NULL ELSE width END AS width", "CASE WHEN image_id % 41 = 0 THEN NULL ELSE height END AS height", "width AS disk_width", "height AS disk_height")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk: some images are missing, and three files belong to none."""
    own = images(spark, sf_dir).filter("image_id % 53 <> 0").select("file_name")
    return own.unionByName(spark.range(3).selectExpr("concat('stray_', id, '.jpg') AS file_name"))


def categories(spark: SparkSession) -> DataFrame:
    return spark.range(1, 5).selectExpr("id", "concat('class_', id) AS name")


_DET = [
    "ann_id * 10 + k AS det_id", "image_id", "fold", "CAST(category_id - 1 AS INT) AS label", "(1 + (pr * (k + 3)) % 997) / 1000.0D AS score",
    "(x + dx) / CAST(width AS DOUBLE) AS x1", "(y + dy) / CAST(height AS DOUBLE) AS y1", "(x + dx + w) / CAST(width AS DOUBLE) AS x2", "(y + dy + h) / CAST(height AS DOUBLE) AS y2",
]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = ["CAST(round(l_extendedprice * 100) AS BIGINT) AS pr", "CAST(round(l_discount * 100) AS INT) AS disc", "CAST(round(l_tax * 100) AS INT) AS tax", "l_returnflag"]
    own = _lines(spark, sf_dir).selectExpr(*_ANN, *more).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).filter("NOT (k = 1 AND l_returnflag = 'N')")
    return own.selectExpr("*", "3 * (disc - 5) + 8 * k AS dx", "3 * (tax - 4) + 6 * k AS dy").selectExpr(*_DET)


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth boxes, normalised."""
    own = annotations(spark, sf_dir)
    return own.selectExpr("image_id", "fold", "ann_id AS gt_id", "x / double(width) AS x1", "y / double(height) AS y1", "(x + w) / double(width) AS x2", "(y + h) / double(height) AS y2")


SQL = f"""
WITH RECURSIVE img AS (SELECT p_partkey AS image_id, 1280 + 64 * p_size AS width, 720 + 36 * p_size AS height, p_partkey % 5 AS fold, 'img_' || p_partkey || '.jpg' AS file_name FROM part),
lines AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(_ORDER)}) AS rn FROM lineitem),
full_lines AS (SELECT * FROM lines JOIN img ON l_partkey = image_id),
ann AS (SELECT {', '.join(_ANN)} FROM full_lines),
det0 AS (SELECT {', '.join(_ANN)}, CAST(round(l_extendedprice * 100) AS BIGINT) AS pr, CAST(round(l_discount * 100) AS INT) AS disc, CAST(round(l_tax * 100) AS INT) AS tax, k FROM full_lines, (SELECT unnest([0, 1]) AS k) WHERE NOT (k = 1 AND l_returnflag = 'N')),
det AS (SELECT {', '.join(_DET).replace('1000.0D', '1000.0::DOUBLE')} FROM (SELECT *, 3 * (disc - 5) + 8 * k AS dx, 3 * (tax - 4) + 6 * k AS dy FROM det0)),
gt AS (SELECT image_id, fold, ann_id AS gt_id, x / CAST(width AS DOUBLE) AS x1, y / CAST(height AS DOUBLE) AS y1, (x + w) / CAST(width AS DOUBLE) AS x2, (y + h) / CAST(height AS DOUBLE) AS y2 FROM ann),
dirty AS (SELECT ann_id AS id, CASE WHEN ann_id % 97 = 0 THEN -1 ELSE image_id END AS image_id, CASE WHEN ann_id % 89 = 0 THEN 99 ELSE category_id END AS category_id,
  ann_id % 83 = 0 AS short, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(CASE WHEN ann_id % 79 = 0 THEN 0 ELSE w END AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h,
  CASE WHEN ann_id % 7 = 0 THEN NULL WHEN ann_id % 7 = 1 THEN 1.5 ELSE CAST(w * h AS DOUBLE) END AS area FROM ann),
dimg AS (SELECT image_id AS id, file_name, CASE WHEN image_id % 41 = 0 THEN NULL ELSE width END AS width, CASE WHEN image_id % 41 = 0 THEN NULL ELSE height END AS height, width AS disk_width, height AS disk_height FROM img),
files AS (SELECT file_name FROM img WHERE image_id % 53 <> 0 UNION ALL SELECT 'stray_' || i || '.jpg' FROM range(3) t(i))
"""


def sql(body: str) -> str:
    """body over the fixture's names; it may go on with further common table expressions, beginning with a comma."""
    return SQL.rstrip() + ("\n" if body.lstrip().startswith(",") else "\n") + body
