"""A folder that driver and executors share, for tables that only one run needs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset a temporary folder serves, which is right only if the executors run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="gridloom-scratch-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        root = _own["dir"]
    return f"{root}/gridloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table at a new path, whose rows stay as they are when a task runs again. The shuffle files that led to it serve nothing more, so Spark may delete them at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def removed(table: DataFrame) -> None:
    """Deletes the files of a written table that nothing will read again."""
    at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_path)
    at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def spread(spark: SparkSession) -> int:
    """Tasks for work that costs far more than its rows' bytes tell; a number that is given is one that adaptive execution does not lower."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
