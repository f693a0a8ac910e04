"""Filter interaction audit over sorted posting lists.

Each row's failures are computed once, in the JVM. Failing rows are dealt by ranges of (part, id) and sorted, so a part of any size spans as many tasks
as it needs. A task keeps, for each part and id range, the sorted list of failing ids of each filter. What a filter removes after others is the
difference of its list and theirs, a k-way merge that gallops through the lists; a union is the sum of such differences. Only sizes leave
the tasks, one row for each part, set of earlier filters and filter, and are summed: id ranges are disjoint, so sizes add up. All orders of the filters
are read off those sums, as what a filter removes depends on the set before it, not on its order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from .arrow import column

#: More filters than this have more orders than a report can list.
MOST_FILTERS = 6
WORD = "[^\\x20\\x09-\\x0D]+"
#: Ids between two anchors of a galloping search.
STRIDE = 64


def seek(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each of ids the place in among of the first id that is not smaller; both ascend.

    Every STRIDE-th id is looked up first; from its place the ids of its range gallop: steps double until they pass the id, and a binary search ends it.
    """
    if not len(ids) or not len(among):
        return np.zeros(len(ids), np.int64)
    low = np.repeat(np.searchsorted(among, ids[::STRIDE]), STRIDE)[: len(ids)]
    high, step, padded = low.copy(), 1, np.append(among, np.iinfo(np.int64).max)
    behind = np.flatnonzero(padded[high] < ids)
    while len(behind):
        low[behind] = high[behind] + 1
        high[behind] = np.minimum(high[behind] + step, len(among))
        behind, step = behind[padded[high[behind]] < ids[behind]], step * 2
    while len(behind := np.flatnonzero(low < high)):
        middle = (low[behind] + high[behind]) // 2
        short = padded[middle] < ids[behind]
        low[behind[short]], high[behind[~short]] = middle[short] + 1, middle[~short]
    return low


def difference(ids: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """The ids that none of the lists has, all ascending; the longest list comes first, so that later ones see few ids."""
    for other in sorted(lists, key=len, reverse=True):
        if len(ids) and len(other):
            at = seek(ids, other)
            ids = ids[other[np.minimum(at, len(other) - 1)] != ids]
    return ids


def sizes(lists: list[np.ndarray], marks: list[np.ndarray]) -> list[list[int]]:
    """For each set of filters (as bits) and each filter outside it: set, filter, its failures, the union of the set, what it removes after the set, and
    how many of those are in each list of marks."""
    union, out = {0: 0}, []
    for before in range(1 << len(lists)):
        others = [ids for f, ids in enumerate(lists) if before >> f & 1]
        for f, own in enumerate(lists):
            if not before >> f & 1:
                removed = difference(own, others)
                union[before | 1 << f] = union[before] + len(removed)
                out.append([before, f, len(own), union[before], len(removed), *(len(removed) - len(difference(removed, [m])) for m in marks)])
    return out


def audit(rows: DataFrame, names: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """rows (part string, key long, unique; fails int: bit i for the i-th of names, one letter each; a boolean column for each of marks) to one row for each
    part, filter_order (all orders of names) and step (from 1): kept, removed, redundant, unique_fails, shapley and, for each mark, <mark>_lost.

    kept: rows of the part after the step; removed: here; redundant: that fail this filter but went before; unique_fails: that fail this filter alone;
    <mark>_lost: removed here with that mark; shapley: removed by this filter, summed over all orders. Zeros are included; a part exists if a row has it.
    No rows give none.
    """
    n = len(names)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")

    def merge(batches):
        for batch in batches:
            parts = column(batch, "part").dictionary_encode()
            part, key, fails = parts.indices.to_numpy(), column(batch, "key").to_numpy(), column(batch, "fails").to_numpy()
            flags = [column(batch, m).to_numpy(zero_copy_only=False) for m in marks]
            for p, name in enumerate(parts.dictionary.to_pylist()):
                own = part == p
                found = sizes([key[own & (fails >> f & 1 > 0)] for f in range(n)], [key[own & m] for m in flags])
                values = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *map(pa.array, values)], ["part", *columns])

    columns = ["before", "filter", "fails", "gone", "removed", *(f"{m}_lost" for m in marks)]
    failing = rows.filter("fails != 0").select("part", "key", "fails", *marks).repartitionByRange("part", "key").sortWithinPartitions("part", "key")
    found = failing.mapInArrow(merge, "part string, " + ", ".join(f"{c} long" for c in columns))
    sums = found.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in columns[2:]])
    every = F.array(*[F.struct(F.lit(s).cast("long").alias("before"), F.lit(f).cast("long").alias("filter")) for s in range(1 << n) for f in range(n) if not s >> f & 1])
    grid = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total")).select("part", "total", F.explode(every).alias("x")).select("part", "total", "x.*")
    cells = grid.join(sums, ["part", "before", "filter"], "left").fillna(0, columns[2:])
    own = W.partitionBy("part", "filter")
    weights = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)])
    rest = F.array(*[F.lit((1 << n) - 1 - (1 << f)) for f in range(n)])[F.col("filter").cast("int")]
    cells = cells.withColumns({
        "shapley": F.sum(F.col("removed") * weights[F.bit_count("before")]).over(own).cast("long"),
        "unique_fails": F.max(F.when(F.col("before") == rest, F.col("removed"))).over(own),
    })
    steps = [("".join(names[f] for f in order), k + 1, sum(1 << f for f in order[:k]), f) for order in permutations(range(n)) for k, f in enumerate(order)]
    steps = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, before long, filter long")
    out = cells.join(F.broadcast(steps), ["before", "filter"])  # n! * n rows, 4,320 at most
    return out.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *(f"{m}_lost" for m in marks), "shapley",
    )


def text_failures(text: Column) -> list[Column]:
    """Of a text: under 50 words; distinct words under 65 % of all; over 5 % of the code points in A to Z; one of # $ % & * |."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return [F.size(words) < 50, F.size(F.array_distinct(words)) * 100 < F.size(words) * 65, (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) * 100 > F.length(text) * 5, text.rlike("[#$%&*|]")]


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of five filters, A to D as in text_failures and E: the text is also that of a smaller id, in any part; see audit for the columns
    (good_lost: label quality 1, toxic_lost: toxic 1).

    A null text counts as empty, a null part is the empty string. Null ids are the largest and not smaller than each other; rows that share an id are rows of their own,
    and not copies of each other. Labels of one id count together; null labels and ids without a row count nothing. An empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    rows = C.keyed(docs.select(C.col(id_col), C.col(text_col), C.col(part_col).alias(_other(id_col, text_col))), id_col, text_col, rows=True)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    bits = F.lit(0)
    for i, failed in enumerate(text_failures(F.col("text"))):
        bits = bits + F.when(failed, 1 << i).otherwise(0)
    part = F.coalesce(F.col("row").getField(_other(id_col, text_col)).cast("string"), F.lit(""))
    marked = C.staged(rows.select("key", "id", part.alias("part"), bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("sha")), "marked")
    copies = C.staged(marked.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first"), "copies")
    copies = F.broadcast(copies) if copies.count() * 64 <= C.BROADCAST_BYTES else copies.hint("merge")
    tags = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("id IS NOT NULL")
    tags = C.staged(tags.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).filter("good OR toxic"), "tags")
    tags = F.broadcast(tags) if tags.count() * 32 <= C.BROADCAST_BYTES else tags.hint("merge")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    rows = marked.join(copies, "sha", "left").join(tags, "id", "left")
    rows = rows.select("part", "key", (F.col("bits") + F.when(again, 16).otherwise(0)).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return audit(C.staged(rows, "failures"), "ABCDE", ("good", "toxic"))


def _other(*taken: str) -> str:
    """A column name that is not taken."""
    name = "part"
    while name in taken:
        name += "_"
    return name


ORACLE = """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
orders(filter_order) AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) UNION ALL
  SELECT filter_order || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(l) WHERE NOT contains(filter_order, l)),
fails AS (SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS f
  FROM texts),
tagged AS (SELECT part, f, count(*) AS n, coalesce(sum(CAST(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS int)), 0) AS good,
    coalesce(sum(CAST(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS int)), 0) AS toxic FROM fails GROUP BY part, f),
steps AS (SELECT filter_order, CAST(s AS int) AS step, filter_order[s] AS l, substr(filter_order, 1, CAST(s AS int) - 1) AS earlier FROM orders, range(1, 6) r(s) WHERE len(filter_order) = 5),
sums AS (SELECT part, filter_order, step, l,
    CAST(coalesce(sum(n) FILTER (translate(f, earlier || l, '') = f), 0) AS bigint) AS kept,
    CAST(coalesce(sum(n) FILTER (contains(f, l) AND translate(f, earlier, '') = f), 0) AS bigint) AS removed,
    CAST(coalesce(sum(n) FILTER (contains(f, l) AND translate(f, earlier, '') != f), 0) AS bigint) AS redundant,
    CAST(coalesce(sum(n) FILTER (f = l), 0) AS bigint) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (contains(f, l) AND translate(f, earlier, '') = f), 0) AS bigint) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (contains(f, l) AND translate(f, earlier, '') = f), 0) AS bigint) AS toxic_lost
  FROM tagged, steps GROUP BY part, filter_order, step, l)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, l) AS bigint) AS shapley FROM sums
"""
