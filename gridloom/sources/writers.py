"""Writers. Tables are written distributed, and so are the lists of documents that are one JSON object."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiling
from . import documents
from .readers import CLEAN, _children, _fs, exists, read_text
from .scratch import spread

#: Columns of the result tables.
RESULTS = ["models", "fold", "mAP50", "mAP75", "mAP", "precision", "recall", "fscore", "MAE", "RMSE", "r", "slicing_time_ms_mean", "slicing_time_ms_total"]
COUNTING = ["models", "fold", "image_name", "groundtruth", "raw_predicted", "predicted", "removed_by_suppression", "TP", "FP", "FN"]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, from the driver, through the path's file system."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value, compact: bool = False) -> None:
    write_text(spark, path, json.dumps(value, separators=(",", ":")) if compact else json.dumps(value, indent=2, ensure_ascii=False))


def write_coco(path: str, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> str:
    """A folder with the annotation document as its one file; the source stays as it is."""
    return write_coco_file(path, images, annotations, categories, "part-00000.json")


def write_coco_file(folder: str, images: DataFrame, annotations: DataFrame, categories: DataFrame, name: str = CLEAN, fixed: dict | None = None, tasks: int | None = None) -> str:
    """The annotation document as one file of that name in the folder, moved there when it is whole; its path. Lists are in the order of ids; fixed: further members, such as info and
    licenses. Written by as many tasks as are given (see documents)."""
    lists = {k: (d, ["id"]) for k, d in (("images", images), ("annotations", annotations), ("categories", categories))}
    return documents.write_document(images.sparkSession, f"{folder}/{name}", lists, fixed, tasks)


def write_fold_stats(path: str, rows: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> str:
    """A fold's statistics (split and per-image metric columns) as one JSON document with a list for each split, in the order of the columns."""
    own = [c for c in rows.columns if c != "split"]
    return documents.write_document(rows.sparkSession, path, {f"{s}_metrics": (rows.filter(F.col("split") == s).select(*own), own) for s in splits})


def write_labels(folder: str, lines: DataFrame) -> None:
    """sample_name, text as a table partitioned for readers of one sample; each text is a label file's content (empty for a tile without boxes)."""
    lines.select("sample_name", F.coalesce("text", F.lit("")).alias("text")).write.mode("overwrite").parquet(folder)


def export_files(folder: str, files: DataFrame) -> int:
    """files (name, content: binary) as files of a mounted folder, written by the tasks that have them. The number of files."""
    spark = files.sparkSession
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("single files are exported to mounted folders; use a table for object stores")
    target = folder.removeprefix("file://").removeprefix("file:")
    fs, at = _fs(spark, folder)
    fs.mkdirs(at)

    def put(batches):
        import os

        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                with open(os.path.join(target, name), "wb") as out:
                    out.write(content or b"")
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("name", "content").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def export_labels(folder: str, lines: DataFrame) -> int:
    """One .txt file for each sample (see export_files)."""
    return export_files(folder, lines.select(F.concat("sample_name", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))


def copy_split(source: str, target: str, names: DataFrame, block: int = 10_000) -> int:
    """Copies the files of a folder that names (file_name) has, in tasks; the number copied. Missing ones are passed over. The folder is listed first, and only chosen
    files are opened, so many at a time as a block has paths. Between mounted folders nothing is listed: tasks copy the files that they have the names of."""
    spark = names.sparkSession
    if not any("://" in p and not p.startswith("file://") for p in (source, target)):
        return _copy_mounted(source, target, names)
    listed = spark.read.format("binaryFile").load(source).select("path").withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    chosen = listed.join(names.select("file_name").distinct(), "file_name", "left_semi").select(F.regexp_replace("path", r"([\[\]{}*?\\])", r"\\$1"))

    def copied(paths: list[str]) -> int:
        rows = spark.read.format("binaryFile").load(paths)
        return export_files(target, rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"))

    n, paths = 0, []
    for (path,) in chosen.toLocalIterator():
        paths.append(path)
        if len(paths) == block:
            n, paths = n + copied(paths), []
    return n + (copied(paths) if paths else 0)


def _copy_mounted(source: str, target: str, names: DataFrame) -> int:
    spark = names.sparkSession
    local = lambda p: p.removeprefix("file://").removeprefix("file:")
    here, there = local(source), local(target)
    fs, at = _fs(spark, target)
    fs.mkdirs(at)

    def put(batches):
        import os
        import shutil

        import pandas as pd

        for pdf in batches:
            n = 0
            for name in pdf["file_name"]:
                hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)  # as Spark's readers
                path = os.path.join(here, name)
                if "/" not in name and not hidden and os.path.isfile(path):
                    shutil.copyfile(path, os.path.join(there, name))
                    n += 1
            yield pd.DataFrame({"n": [n]})

    chosen = names.select("file_name").filter("file_name IS NOT NULL").distinct().repartition(spread(spark), "file_name")
    return chosen.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_fold_yaml(spark: SparkSession, path: str, root: str, names: list[str], test: bool = True) -> None:
    """The training configuration of a fold."""
    parts = ["train", "val", *(["test"] if test else [])]
    lines = [f"path: {root}", *[f"{p}: {p}/images" for p in parts], f"nc: {len(names)}", "names:", *[f"  {i}: {n}" for i, n in enumerate(names)]]
    write_text(spark, path, "\n".join(lines) + "\n")


def append_csv(df: DataFrame, folder: str, columns: list[str]) -> None:
    """Rows added to a folder of CSV files with these columns. Another header there is archived first; rows are never deduplicated."""
    spark, header = df.sparkSession, ",".join(columns)
    mark = f"{folder}/_header"
    if exists(spark, folder):
        if not exists(spark, mark) or read_text(spark, mark).strip() != header:
            fs, at = _fs(spark, folder)
            if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}.before-{uuid.uuid4().hex}")):
                raise OSError(f"{folder} could not be archived")
    df.select(*columns).write.mode("append").option("header", True).csv(folder)
    if not exists(spark, mark):
        write_text(spark, mark, header)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def write_folds(df: DataFrame, folder: str) -> None:
    """Overwrites the folds that df has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(folder)


def write_detections(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split", "arch", "dataset", "fold").parquet(path)


def write_tiles(df: DataFrame, folder: str) -> None:
    """Tile metadata, a JSON object for each tile."""
    df.write.mode("overwrite").json(folder)


def slicing_configs(tiled: DataFrame, t: tiling.Tiling) -> DataFrame:
    """image_id and config: the saved configuration of each image's tiling as JSON, with the image's id and, for fixed tiles, how
    the last tile of an axis overlaps the one before it. tiled has tile names. An axis with one position has no coverage entry."""
    c = F.col
    tile = F.struct("row_index", "column_index", "tile_file", "x", "y", c("tile_width").alias("width"), c("tile_height").alias("height"))
    own = tiled.groupBy("image_id", "file_name", c("width").alias("original_width"), c("height").alias("original_height")).agg(F.array_sort(F.collect_list(tile)).alias("all"))
    parts = [F.lit(t.mode).alias("slicing_method"), c("file_name").alias("source_image"), "original_width", "original_height", F.size("all").alias("tile_count"),
             F.transform("all", lambda x: F.struct(x["tile_file"].alias("tile_file"), x["x"].alias("x"), x["y"].alias("y"), x["width"].alias("width"), x["height"].alias("height"))).alias("tiles")]
    if t.kind in ("asahi", "asahi_rect"):
        last = F.element_at("all", -1)
        parts += [F.array(c("all")[0]["width"], c("all")[0]["height"]).alias("tile_size"), F.lit(t.overlap).alias("overlap_ratio"), (last["column_index"] + 1).alias("grid_cols"), (last["row_index"] + 1).alias("grid_rows")]
    else:
        edge = tiling.edge_coverage(tiled, t, ["image_id"])
        entry = F.struct("axis", F.struct(*[x for x in edge.columns if x not in ("image_id", "axis")]).alias("v"))
        own = own.join(edge.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("edge_coverage")), "image_id", "left")
        (w, h), (sx, sy) = t.tile, t.stride
        parts += [F.array(F.lit(w), F.lit(h)).alias("tile_size"), *[F.lit(v).alias(k) for k, v in (("stride_x", sx), ("stride_y", sy), ("overlap_x", w - sx), ("overlap_y", h - sy))], "edge_coverage"]
    return own.select("image_id", F.to_json(F.struct(*parts, c("image_id").alias("id_image"))).alias("config"))


def checkpoint_manifest(mode: str, fold: int, model: str, engine: str, checkpoint: str, source: str) -> dict:
    return {"mode": mode, "fold": fold, "model": model, "engine": engine, "checkpoint": checkpoint, "source": source}


def weight_manifests(spark: SparkSession, weights: str, models: str, mode: str, folds: int, engine_of, endings: tuple[str, ...] = (".pt", ".pth")) -> list[str]:
    """Writes a manifest for each model folder under weights/mode/model_checkpoints/fold_N that has a weight file and a known engine; their paths."""
    out = []
    for fold in range(1, folds + 1):
        root = f"{weights}/{mode}/model_checkpoints/fold_{fold}"
        for model in _children(spark, root):
            try:
                engine = engine_of(model)
            except ValueError:
                continue
            if found := [n for n in _children(spark, f"{root}/{model}") if n.endswith(endings)]:
                path = f"{models}/{mode}/fold_{fold}/{model}/manifest.json"
                write_json(spark, path, checkpoint_manifest(mode, fold, model, engine, f"{root}/{model}/{found[0]}", "weights"))
                out.append(path)
    return out


def dataset_manifest(mode: str, folds: int, classes: list[str], counts: list[dict], **settings) -> dict:
    return {"slicing_mode": mode, "n_folds": folds, "classes": classes, "folds": counts} | settings


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a run's folder; whether there was one."""
    fs, at = _fs(spark, path)
    return fs.delete(at, True)
