"""Prefix scans over a whole ordered table: row numbers and running sums in which no task holds more than a range of the order.

Rows are dealt to ranges of the order and sorted in each; the ranges' totals, one row for each task (and group), give what stands before a range. The ranges are
written once, because numbers must stay the same when a task runs again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from .boxes import changes

_LOW = (1 << 33) - 1


def ranged(df: DataFrame, order: list, tasks: int | None = None, inside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df as a table, sorted by order within ranges of it: _task names the range, ranges ascend, and _row is the place in it, from 0. With inside it has what that
    makes of the rows (with _task) of each range as they pass."""
    dealt = df.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id())
    return written(inside(dealt) if inside else dealt.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))), "ranges")


def numbered(df: DataFrame, order: list, name: str = "n", tasks: int | None = None) -> DataFrame:
    """df with the place of each row in this order, from 1. Rows that tie in it have places in any order, but always the same."""
    rows = ranged(df, order, tasks)
    counts = sorted((r["_task"], r["count"]) for r in rows.groupBy("_task").count().collect())  # a row for each task
    before, offsets = 0, []
    for task, n in counts:
        offsets.append((task, before))
        before += n
    offsets = df.sparkSession.createDataFrame(offsets, "_task int, _before long")
    return rows.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_row") + F.col("_before") + 1).select(*df.columns, name)


def running(df: DataFrame, order: list, sums: dict[str, Column], by: tuple[str, ...] = (), tasks: int | None = None, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """df (those of its rows that meet where, and these columns) with running sums (this row's value included) of whole numbers in this order, over all rows within groups of the columns `by`.

    A group may span any number of ranges. A task sums up a range as its rows pass and writes the rows that are wanted; what earlier ranges add is a join with the totals
    of the groups that span several, of which a range has two at most. Nulls count as 0; null keys are a group.
    """
    columns, own = columns or df.columns, [f"_sum_{k}" for k in sums]
    kept = [*dict.fromkeys((*by, *columns))]
    made = [F.coalesce(v.cast("long"), F.lit(0).cast("long")).alias(f"_sum_{k}") for k, v in sums.items()]  # once the rows are dealt
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("_keep", T.BooleanType()), T.StructField("_task", T.IntegerType()), T.StructField("_end", T.BooleanType()), *[T.StructField(f"_in_{k}", T.LongType()) for k in sums]])
    names, keep = [*kept, "_keep", "_task"], (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("_keep")

    def summed(batches):
        held, before = None, np.zeros(len(own), np.int64)  # the last row waits for the next, which tells whether its group ends; before: its group's sums without it
        for batch in batches:
            if not batch.num_rows:
                continue
            (rows,) = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks().to_batches()
            last = np.append(changes([rows.column(c) for c in by]) if by else np.zeros(rows.num_rows - 1, bool), False)
            values = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in own], axis=1)
            total = values.cumsum(axis=0)
            first = np.maximum.accumulate(np.where(np.append(True, last[:-1]), np.arange(len(last)), 0))
            total = total - (total - values)[first] + np.where(first == 0, 1, 0)[:, None] * before
            before, held = total[-1] - values[-1], rows.slice(rows.num_rows - 1)
            yield done(rows.slice(0, rows.num_rows - 1), last[:-1], total[:-1])
        if held:
            yield done(held, np.array([True]), total[-1:])

    def done(rows, last, total):
        at = np.flatnonzero(last | rows.column("_keep").to_numpy(zero_copy_only=False))
        same = rows.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*[same.column(c) for c in names], pa.array(last[at]), *[pa.array(total[at, i]) for i in range(len(own))]], schema.names)

    rows = ranged(df, [*by, *order], tasks, lambda dealt: dealt.select(*kept, keep, "_task", *made).mapInArrow(summed, schema))
    totals = rows.filter("_end").select(*by, "_task", *[F.col(f"_in_{k}").alias(f"_total_{k}") for k in sums])
    totals = totals.withColumn("_ranges", F.count(F.lit(1)).over(W.partitionBy(*by))).filter("_ranges > 1") if by else totals
    earlier = W.partitionBy(*by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_key_{c}") for c in by], F.col("_task").alias("_key_task"), *[F.coalesce(F.sum(f"_total_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums])
    same = F.col("_task") == F.col("_key_task")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    rows = rows.filter("_keep").join(F.broadcast(before), same, "left")  # two rows for each task at most
    return rows.select(*columns, *[(F.col(f"_in_{k}") + F.coalesce(f"_before_{k}", F.lit(0))).alias(k) for k in sums])
