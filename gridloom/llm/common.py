"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that an operator broadcasts. Each caller works out the size before it broadcasts.
BROADCAST_BYTES = 32 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a temporary folder serves, which is right only if the executors run on this machine.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table written in the shared folder (partitioned by a column, if one is named): it cuts the lineage and outlives lost executors.

    Once it is written, the shuffle files that led to it serve nothing, so Spark may delete them at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(df: DataFrame, partition: str = "") -> None:
    """Deletes the files of a staged table, or of one of its partitions, that nothing will read again."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path + "/" + partition)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the whole row in one struct, so that no helper column can clash with a column of df."""
    return df.select(col(id_col).alias("id"), col(text_col).alias("text"), F.struct(*[col(c) for c in df.columns]).alias("row"))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """(key long, id, text), and row (see packed) if wanted: key is unique and orders rows as id does, nulls last.

    Where ids are unique integers the key is the id, and nothing moves but the ids that are counted. Else rows are sorted by id (ties by
    text) and numbered in a table in the shared folder.
    """
    base = packed(df, id_col, text_col).withColumn("text", F.col("text").cast("string"))
    base = base if rows else base.drop("row")
    kind = base.schema["id"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        again = base.select("id").groupBy("id").count().filter("count > 1 OR id IS NULL").limit(1).count()
        if not again:
            return base.select(F.col("id").cast("long").alias("key"), *base.columns)
    order = base.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"))
    return staged(order.select(F.monotonically_increasing_id().alias("key"), *base.columns), "keyed")
