"""Files of a mounted folder, listed by one task as a stream and read by many: the driver holds neither names nor contents."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scratch import spread, written

#: Names in a batch, files that a task reads, and bytes of contents in a batch.
NAMES, FILES, BYTES = 10_000, 20_000, 4 << 20


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The path by which tasks open the files of a mounted folder; None for anything else."""
    fs, at = _fs(spark, folder)
    if fs.getUri().getScheme() != "file" or not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return None
    return fs.makeQualified(at).toUri().getPath()


def hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file of this name."""
    return (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)) and not name.startswith(("_metadata", "_common_metadata"))


def _below(root: str) -> Iterator[str]:
    """Paths below root of the files in it and in its folders of partitions (a=b)."""
    folders = [""]
    while folders:
        at = folders.pop()
        with os.scandir(os.path.join(root, at)) as entries:
            for e in entries:
                if hidden(e.name):
                    continue
                if not e.is_dir():
                    yield os.path.join(at, e.name)
                elif "=" in e.name:
                    folders.append(os.path.join(at, e.name))


def listed(spark: SparkSession, root: str, wanted: Callable[[str], bool] = bool) -> DataFrame:
    """path (below root) of the files there whose path is wanted, as a table."""

    def run(batches):
        for _ in batches:
            pass
        own = []
        for path in _below(root):
            if wanted(path):
                own.append(path)
            if len(own) == NAMES:
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["path"])
                own = []
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["path"])

    return written(spark.range(1, numPartitions=1).mapInArrow(run, "path string"), "listing")


def dealt(names: DataFrame) -> DataFrame:
    """A table of paths, dealt to so many tasks as their files need."""
    return names.repartition(max(spread(names.sparkSession), names.count() // FILES + 1))


def batched(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """rows as record batches of so many bytes, by the size of each row."""
    own, n = [], 0
    for row in rows:
        own.append(row)
        n += size(row)
        if n >= BYTES or len(own) == NAMES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own, strict=True), kinds, strict=True)], names)
            own, n = [], 0
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own, strict=True), kinds, strict=True)], names)


def content(path: str) -> bytes:
    with open(path, "rb", buffering=0) as f:
        return f.read()


def contents(names: DataFrame, root: str) -> DataFrame:
    """path, content of the files that names has the paths of."""

    def run(batches):
        rows = ((p, content(os.path.join(root, p))) for b in batches for p in b.column("path").to_pylist())
        yield from batched(rows, ["path", "content"], [pa.string(), pa.binary()], lambda r: len(r[1]))

    return dealt(names).mapInArrow(run, "path string, content binary")
