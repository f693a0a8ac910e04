"""Readers. Paths go through Spark's file systems; only configuration and manifests are read by the driver, through the same file systems."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import documents, files
from .files import _fs
from .scratch import spread

#: Names of annotation files in an image folder, the cleaned one first; image endings.
CLEAN, RAW = "_annotations_clean.coco.json", "_annotations.coco.json"
ENDINGS = ("jpg", "jpeg", "png")

_L, _D, _S, _I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()
IMAGE = T.StructType([T.StructField("id", _L), T.StructField("file_name", _S), T.StructField("width", _I), T.StructField("height", _I)])
ANNOTATION = T.StructType([T.StructField("id", _L), T.StructField("image_id", _L), T.StructField("category_id", _L), T.StructField("bbox", T.ArrayType(_D)), T.StructField("area", _D), T.StructField("iscrowd", _I)])
CATEGORY = T.StructType([T.StructField("id", _L), T.StructField("name", _S)])
DETECTION = "split string, arch string, dataset string, fold int, image string, det_id long, label int, score double, x1 double, y1 double, x2 double, y2 double"


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    """One file at the driver, also one whose name starts with an underscore, which Spark's readers pass over."""
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def annotation_path(spark: SparkSession, folder: str) -> str | None:
    """The cleaned annotation file of a folder, else the raw one, else None."""
    return next((p for p in (f"{folder}/{CLEAN}", f"{folder}/{RAW}") if exists(spark, p)), None)


def coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations and categories of an annotation file, or of a folder's."""
    if not path.endswith(".json"):
        found = annotation_path(spark, path)
        if not found:
            raise FileNotFoundError(f"no annotation file in {path}")
        path = found
    folder = documents.sections(spark, path)
    return {k: listed(spark, folder, k, kind) for k, kind in (("images", IMAGE), ("annotations", ANNOTATION), ("categories", CATEGORY))}


def listed(spark: SparkSession, folder: str, part: str, schema: T.StructType) -> DataFrame:
    """Entries of one list of a document (see documents.sections); none where it has no such list."""
    return spark.read.schema(schema).json(f"{folder}/section={part}") if exists(spark, f"{folder}/section={part}") else spark.createDataFrame([], schema)


def coco_raw(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Entries of one part with every field they have: id and the entry as JSON text."""
    folder = f"{documents.sections(spark, path)}/section={part}"
    text = spark.read.text(folder) if exists(spark, folder) else spark.createDataFrame([], "value string")
    text = text.select(F.from_json("value", "map<string,string>").alias("e"))
    return text.select(F.col("e")["id"].cast("long").alias("id"), F.to_json("e").alias("entry"))


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, path and bytes of a folder's images, by their endings in any case, sorted by name. Contents are not read. A mounted folder is listed by a task and its files'
    bytes are asked for by many; that of any other folder is listed by Spark, at the driver."""
    if root := files.mounted(spark, folder):

        def sized(batches):
            for b in batches:
                size = [os.stat(os.path.join(root, p)).st_size for p in b.column("path").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(size, pa.int64()), b.column("file_name")], ["path", "bytes", "file_name"])

        found = files.listed(spark, root, lambda p: p.lower().endswith(tuple(f".{e}" for e in ENDINGS))).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
        found = found.orderBy("file_name").mapInArrow(sized, "path string, bytes long, file_name string")
        return found.withColumn("path", F.concat(F.lit(f"file:{root}/"), "path"))
    rows = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("file_name", name).filter(F.lower("file_name").rlike(rf"\.({'|'.join(ENDINGS)})$")).orderBy("file_name")


def source_bytes(images: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: bytes of the files that images name."""
    return listing.join(images.select("file_name").distinct(), "file_name", "left_semi").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, disk_width and disk_height of the images that can be decoded."""
    from . import pixels

    return pixels.decoded(spark, folder).select("file_name", F.col("width").alias("disk_width"), F.col("height").alias("disk_height"))


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """sample_name, text of a folder's label files (see image_listing for who lists them)."""
    if root := files.mounted(spark, folder):
        rows = files.contents(files.listed(spark, root, lambda p: p.endswith(".txt")), root)
        return rows.select(F.element_at(F.split("path", "/"), -1).alias("sample_name"), F.col("content").cast("string").alias("text"))
    own = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)  # a pattern in the path would make each file a root of its own on the driver
    rows = own.select(F.col("_metadata.file_name").alias("sample_name"), F.col("value").alias("text")).coalesce(spread(spark))  # Spark makes a task of some thirty small files
    return rows


def parsed_labels(lines: DataFrame) -> DataFrame:
    """sample_name, line_no, cls, cx, cy, w, h. Lines with fewer than five tokens are skipped; further tokens are ignored."""
    rows = lines.select("sample_name", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    part = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = rows.select("sample_name", "line_no", part.alias("p")).filter(F.size("p") >= 5)
    return rows.select("sample_name", "line_no", F.col("p")[0].cast("double").cast("int").alias("cls"), *[F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])


def detections(spark: SparkSession, path: str) -> DataFrame:
    """The raw detection cache, partitioned by split, arch, dataset and fold; it is never collected anew here."""
    return spark.read.parquet(path)


def cached(spark: SparkSession, path: str, collect) -> DataFrame:
    """The cache at path; collect() makes it where it does not exist, or where a run that died left a part of it."""
    if not exists(spark, f"{path}/_SUCCESS"):
        collect().write.mode("overwrite").parquet(path)
    return detections(spark, path)


def fold_stats(spark: SparkSession, *paths: str) -> DataFrame:
    """Per-image metrics of a fold's statistics from the first path that exists: split and the metric columns."""
    path = next((p for p in paths if exists(spark, p)), None)
    if not path:
        raise FileNotFoundError(f"no fold statistics at {', '.join(paths)}")
    folder = documents.sections(spark, path)
    parts = [spark.read.json(f).select(F.lit(s).alias("split"), "*") for s in ("train", "val", "test") if exists(spark, f := f"{folder}/section={s}_metrics")]
    if not parts:
        return spark.createDataFrame([], "split string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def slicing_config(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def config_overlap(config: dict) -> float:
    """The overlap of a saved slicing configuration: its ratio, or its pixels over the tile's width."""
    return config.get("overlap_ratio") or config["overlap_x"] / config["tile_size"][0]


def _children(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def folds(spark: SparkSession, *folders: str) -> list[str]:
    """Paths of fold_N.yaml files in the first folder that has any, by number."""
    for folder in folders:
        own = [n for n in _children(spark, folder) if n.startswith("fold_") and n.endswith(".yaml")]
        if own:
            return [f"{folder}/{n}" for n in sorted(own, key=lambda n: int("".join(filter(str.isdigit, n)) or 0))]
    raise FileNotFoundError(f"no fold files in {', '.join(folders)}")


def next_id(spark: SparkSession, folder: str) -> int:
    """One more than the greatest number that names an entry of the folder."""
    return 1 + max((int(n) for n in _children(spark, folder) if n.isdigit()), default=0)


def checkpoint(spark: SparkSession, root: str, dataset: str, fold: int, model: str) -> str:
    """The weights that a model's manifest names; a relative name is looked up beside the manifest."""
    upper = model.upper()
    folder = f"{root}/{dataset}/fold_{fold}/{'detr' if upper == 'DETR' else 'Faster' if upper == 'FASTER' else model}"
    if not exists(spark, f"{folder}/manifest.json"):
        raise FileNotFoundError(f"no manifest in {folder}")
    named = json.loads(read_text(spark, f"{folder}/manifest.json")).get("checkpoint", "")
    path = named if named.startswith("/") or "://" in named else f"{folder}/{named}"
    if not named or not exists(spark, path):
        raise FileNotFoundError(f"no checkpoint {path}")
    return path
