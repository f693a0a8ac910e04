"""A cache of raw detections that grows run by run. A run collects the images that no earlier one has committed; it may die at any point or repeat, and images are
neither lost nor doubled: what a run wrote counts only once its list of images stands in the log, and it gets there by one rename.

Folders: data/run=<id> (partitioned by split, arch, dataset and fold), log/run=<id> (the images that the run has done, also those without a detection), pending/<id>.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import DETECTION, _fs, exists

KEYS = ("split", "arch", "dataset", "fold", "image")
_KEYS = "split string, arch string, dataset string, fold int, image string"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """split, arch, dataset, fold, image and run of all images that runs have done; an image that several did belongs to the first by id."""
    if not exists(spark, f"{path}/log"):
        return spark.createDataFrame([], f"{_KEYS}, run string")
    return spark.read.schema(f"{_KEYS}, run string").parquet(f"{path}/log").groupBy(*KEYS).agg(F.min("run").alias("run"))


def detections(spark: SparkSession, path: str) -> DataFrame:
    """The detections of all committed images."""
    if not exists(spark, f"{path}/data"):
        return spark.createDataFrame([], DETECTION)
    rows = spark.read.schema(f"{DETECTION}, run string").parquet(f"{path}/data")
    return rows.join(committed(spark, path), [*KEYS, "run"], "left_semi").drop("run")


def missing(wanted: DataFrame, path: str) -> DataFrame:
    """Of wanted (split, arch, dataset, fold, image) what no run has committed."""
    return wanted.select(*KEYS).distinct().join(committed(wanted.sparkSession, path), list(KEYS), "left_anti")


def collect(wanted: DataFrame, path: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache's detections after the missing ones of wanted have been added: run makes them (all columns of DETECTION) from a table of keys."""
    spark, name = wanted.sparkSession, uuid.uuid4().hex
    left = f"{path}/pending/{name}"
    missing(wanted, path).write.parquet(left)
    todo = spark.read.schema(_KEYS).parquet(left)
    if todo.limit(1).count():
        run(todo).write.partitionBy("split", "arch", "dataset", "fold").parquet(f"{path}/data/run={name}")
        fs, at = _fs(spark, left)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(hadoop(f"{path}/log"))
        if not fs.rename(at, hadoop(f"{path}/log/run={name}")):
            raise OSError(f"run {name} could not be committed")
    return detections(spark, path)


def tidy(spark: SparkSession, path: str) -> int:
    """Deletes what runs that died have left; the number of such runs. No run may be under way."""
    from .readers import _children

    known = set(_children(spark, f"{path}/log"))
    dead = [f"{path}/data/{n}" for n in _children(spark, f"{path}/data") if n.startswith("run=") and n not in known] + [f"{path}/pending/{n}" for n in _children(spark, f"{path}/pending")]
    for p in dead:
        fs, at = _fs(spark, p)
        fs.delete(at, True)
    return len({p.rsplit("/", 1)[-1].removeprefix("run=") for p in dead})
