"""Engines that fail on some rows: failures are kept row by row, and every other row has its results.

A batch that raises is halved until the rows that fail are alone, so one bad row among n costs about log2(n) further calls, and the model stays loaded. One
pass over the rows gives results, failures and a mark for each row that was done; they are written once, a folder for each, so no reader runs the engine again.
Where a row that fails spoils its whole group, groups are halved, and a group's search ends at its first row that fails.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import scratch

#: How a failure reads.
ERROR = "{type}: {text}"
#: Bytes up to which the groups that failed are broadcast, and the setting that lets a task write its folders side by side, without a sort.
SMALL = 32 << 20
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@dataclass(frozen=True)
class Outcome:
    """results: what the engine found; failures: the key columns and error of each row that failed; done: the keys of the others; counts: rows done, failed, results."""

    results: DataFrame
    failures: DataFrame
    done: DataFrame
    counts: dict[str, int]

    def checked(self) -> Outcome:
        """This outcome; RuntimeError if rows failed and none was done."""
        if self.counts["failed"] and not self.counts["done"]:
            raise RuntimeError(f"all {self.counts['failed']} rows failed")
        return self


def halved(frame, predict: Callable):
    """(rows, result or None, exception or None) of the largest parts, by halving, that predict takes whole; single rows for those that it fails on. In order."""
    parts = [frame]
    while parts:
        part = parts.pop()
        try:
            found = predict(part)
        except Exception as e:  # whatever a model raises is that row's failure
            if len(part) == 1:
                yield part, None, e
            else:
                parts += [part.iloc[len(part) // 2 :], part.iloc[: len(part) // 2]]
        else:
            yield part, found, None


def halved_by_group(frame, first: np.ndarray, predict: Callable):
    """(places of rows, result or None, exception or None) of the largest runs of whole groups (which begin at first), by halving, that predict takes: the first row of
    each; for a group that it fails on, the first row that fails, and nothing of its other rows."""
    ends, parts = np.append(first, len(frame)), [(0, len(first))]
    while parts:
        a, b = parts.pop()
        low, high = ends[a], ends[b]
        try:
            found = predict(frame.iloc[low:high])
        except Exception as e:  # as in halved
            if b - a > 1:
                parts += [((a + b) // 2, b), (a, (a + b) // 2)]
            elif high - low == 1:
                yield ends[a:b], None, e
            else:
                place, own = low, []
                for part, result, error in (x for half in (frame.iloc[low : (low + high) // 2], frame.iloc[(low + high) // 2 : high]) for x in halved(half, predict)):
                    if error is not None:
                        own = [(ends[a:b] * 0 + place, None, error)]
                        break
                    own.append((ends[a:b][: not own], result, None))  # a group is done once
                    place += len(part)
                yield from own
        else:
            yield ends[a:b], found, None


def captured(rows: DataFrame, load: Callable[[], Callable], schema: str | T.StructType, keys: tuple[str, ...], group: str | None = None, order: tuple[str, ...] = ()) -> Outcome:
    """rows through an engine. load, called once in each worker, returns a function from a pandas frame of rows to one with the columns of schema.

    keys name a row in done and failures. A row is done if the engine took it, whether or not it found anything there. What ends a worker, and an error in load,
    fails the task, not the row. No rows give empty tables. With a group, outcomes are for by_group, with the same order: of a group's rows in a batch failures has the first
    that fails, or done the first, and after one that fails no other is run.
    """
    spark = rows.sparkSession
    found = spark.createDataFrame([], schema).schema
    own = T.StructType([rows.schema[k] for k in keys])
    whole = T.StructType([T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("row", own), T.StructField("found", found)])
    kind = to_arrow_schema(whole)

    def marked(status: str, n: int, **columns) -> pa.RecordBatch:
        """n rows with this status; of the other columns those that aren't given are null."""
        given = {"status": pa.array([status] * n, pa.string()), **columns}
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in kind], schema=kind)

    def struct(name: str, frame) -> pa.Array:
        fields = list(kind.field(name).type)
        return pa.StructArray.from_arrays([pa.Array.from_pandas(frame[f.name], type=f.type) for f in fields], fields=fields)

    def outcomes(frame, predict):
        """(frame, (places, result, exception)s); with a group the frame is sorted."""
        if group:
            frame = frame.sort_values([group, *order], kind="stable", ignore_index=True)
            own = frame[group].to_numpy()
            return frame, halved_by_group(frame, np.flatnonzero(np.append(True, own[1:] != own[:-1])), predict)
        frame = frame.reset_index(drop=True)
        return frame, ((part.index.to_numpy(), result, error) for part, result, error in halved(frame, predict))

    def run(batches):
        import pandas as pd

        predict = None
        for batch in batches:
            predict = predict or load()
            if not batch.num_rows:
                continue
            done, results, failed, errors = [], [], [], []
            frame, parts = outcomes(batch.to_pandas(), predict)
            for places, result, error in parts:
                if error is not None:
                    failed.append(places)
                    errors.append(ERROR.format(type=type(error).__name__, text=error))
                    continue
                done.append(places)
                if len(result):
                    results.append(result)
            for status, at, more in (("failed", failed, {"error": pa.array(errors, pa.string())}), ("done", done, {})):
                if at and len(at := np.concatenate(at)):
                    yield marked(status, len(at), row=struct("row", frame[list(keys)].take(at)), **more)
            if results:
                found_part = pd.concat([r if list(r.columns) == found.names else r[found.names] for r in results], ignore_index=True)
                yield marked("results", len(found_part), found=struct("found", found_part))

    path, seen = scratch(spark, "outcome"), Observation()
    each = [F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s) for s in ("done", "failed", "results")]
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, len(each) + 1)
    try:
        rows.mapInArrow(run, whole).observe(seen, *each).write.partitionBy("status").parquet(path)
    finally:
        spark.conf.set(_WRITERS, before) if before is not None else spark.conf.unset(_WRITERS)
    kept = spark.read.schema(T.StructType([*whole.fields[1:], whole.fields[0]])).parquet(path)
    of = lambda s: kept.filter(F.col("status") == s)
    return Outcome(of("results").select("found.*"), of("failed").select("row.*", "error"), of("done").select("row.*"), dict(seen.get))


def by_group(outcome: Outcome, group: str, order: tuple[str, ...]) -> Outcome:
    """An outcome of parts (such as tiles) as one of their groups (such as images): a group with a part that failed fails whole, with the error of the first part in this
    order, and has no results; results have the column group. counts are of groups, and of the results that are left."""
    failed = outcome.failures.groupBy(group).agg(F.min(F.struct(*order, "error")).alias("x")).select(group, "x.error")
    n = failed.count()
    gone = failed.select(group)
    gone = F.broadcast(gone) if n * 64 <= SMALL else gone
    results = outcome.results.join(gone, group, "left_anti") if n else outcome.results
    done = outcome.done.select(group).distinct()
    done = done.join(gone, group, "left_anti") if n else done
    return Outcome(results, failed, done, {"done": done.count(), "failed": n, "results": results.count()})
