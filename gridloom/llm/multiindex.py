"""Approximate nearest neighbours by largest inner product, through an inverted multi-index.

Both halves of a vector are quantised separately, so a few centroids each give their square of cells. A query takes the pairs of centroids in the order of
their summed distance (minus the halves' inner products, as nearness is the inner product) from a heap, until the cells it has seen hold a given share
of the index, and their entries are ranked by the exact measure.

Centroids and the share are fitted on a bounded sample (SAMPLE rows by hash of their ids): the share is where the sample's own queries have met TARGET of their true
neighbours. Every row is indexed. Equal vectors are one entry with the smallest ids that any result can need, so a vector of any frequency costs no
more than another. Cells are gathered into buckets of bounded size; a larger cell is dealt to several. Each query goes once to each bucket that it visits, with its cells;
a bucket with many visits is read by several tasks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from .arrow import column, lists, ranges

#: Rows that the index is fitted on, at most; of those the queries that set the share; the share of their true neighbours to be met.
SAMPLE, TRIED, TARGET = 16_384, 256, 0.96
#: Centroids of a half at most (cells: the square), and entries of a cell on average below that.
CENTROIDS, CELL = 256, 64
ROUNDS = 12
#: Entries of a bucket, and visits for which its entries are read by another task.
BUCKET, VISITS = 8_192, 8_192
#: Scores (8 bytes each) that a task holds at once.
SCORES = 1 << 21


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids (fewer where x has fewer distinct rows), from distinct rows of x at random."""
    r = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[r.permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centroids)
        count = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * x @ centroids.T, axis=1)


def traverse(one: np.ndarray, two: np.ndarray, counts: np.ndarray, need: float) -> list[int]:
    """Cells by ascending one[i] + two[j], until those seen hold `need` entries; counts: entries of cell i * len(two) + j. Empty cells are left out.

    The heap holds pairs whose neighbours with a smaller sum are done: at most one for each i.
    """
    first, second = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    one, two, wide = one[first].tolist(), two[second].tolist(), len(second)
    heap, out, seen, size = [(one[0] + two[0], 0, 0)], [], 0, counts.tolist() if isinstance(counts, np.ndarray) else counts
    while heap and seen < need:
        _, i, j = heapq.heappop(heap)
        if here := size[cell := first[i] * wide + second[j]]:
            out.append(cell)
            seen += here
        if j + 1 < wide:
            heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
        if not j and i + 1 < len(one):
            heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))
    return out


class MultiIndex:
    """Centroids of both halves, and the share of the index that a query visits."""

    def __init__(self, sample: np.ndarray, total: int, k: int, seed: int = 42, target: float = TARGET):
        self.cut = sample.shape[1] // 2
        size = int(np.clip(2 ** np.round(np.log2(max(1, total / CELL)) / 2), 2, CENTROIDS))
        self.one, self.two = kmeans(sample[:, : self.cut], size, seed), kmeans(sample[:, self.cut :], size, seed + 1)
        self.share = self._share(sample, k, target, seed)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.cut], self.one) * len(self.two) + nearest(x[:, self.cut :], self.two)

    def _share(self, sample: np.ndarray, k: int, target: float, seed: int) -> float:
        """The share of the sample in the cells up to that of a true neighbour, in the order of the traversal: its quantile over neighbours of sample queries."""
        tried = np.random.default_rng(seed).permutation(len(sample))[:TRIED]
        own = self.cells(sample)
        counts = np.bincount(own, minlength=len(self.one) * len(self.two))
        met = []
        for q in tried:
            score = sample @ sample[q]
            score[q] = -np.inf
            near = np.argsort(-score)[: min(k, len(sample) - 1)]
            sums = (-self.one @ sample[q, : self.cut])[:, None] - (self.two @ sample[q, self.cut :])[None, :]
            order = np.argsort(sums.ravel(), kind="stable")
            upto = np.empty(len(order))
            upto[order] = np.cumsum(counts[order])
            met.append(upto[own[near]] / len(sample))
        met = np.concatenate(met) if met else np.empty(0)
        return float(np.quantile(met, target)) if len(met) else 1.0


class Buckets:
    """Cells dealt, in order, to buckets of about `size` entries; a cell with more has buckets of its own."""

    def __init__(self, counts: np.ndarray, size: int):
        self.parts = np.maximum(1, -(-counts // size))  # buckets of a cell
        small, self.first, at, room = self.parts == 1, np.empty(len(counts), np.int64), 0, 0
        for i, n in enumerate(counts.tolist()):
            if not small[i]:
                at += room > 0
                self.first[i], room = at, 0
                at += int(self.parts[i])
            else:
                if room + n > size:
                    at, room = at + 1, 0
                self.first[i], room = at, room + n

    def visits(self, cells: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of these cells and the cells again, one of each for each bucket of a cell, ordered by bucket."""
        cells = np.array(cells, np.int64)
        parts = self.parts[cells]
        at, again = ranges(self.first[cells], parts), np.repeat(cells, parts)
        order = np.argsort(at, kind="stable")
        return at[order], again[order]


def _matrix(batch, name: str, dims: int) -> np.ndarray:
    """The float lists of a column, all of `dims` values, as doubles."""
    own = column(batch, name)
    return (own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner products of rows, in double precision, summed in the order of the components: equal vectors have equal scores."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return total


def nearest_neighbours(df: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, target: float = TARGET, bucket: int = BUCKET, visits: int = VISITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row for which `queries` (a condition on the column id) holds the k nearest other rows found, by the largest inner
    product in double precision, ties to the smaller id; all others where they are fewer than k.

    Ids are whole numbers. Rows whose id is null, or whose vector is null, zero, of another length than most or with a null or non-finite component, take no part;
    of rows that share an id that with the smallest vector does. Equal vectors are equally near. An empty table, or one without queries, gives no
    rows. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    vector = C.col(vector_col)
    rows = df.select(C.col(id_col).cast("long").alias("id"), vector.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(sound).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")) if "float" in dict(rows.dtypes)["v"] else F.transform("v", lambda x: x.cast("double") + 0.0))  # -0 is 0
    usual = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not usual:
        return spark.createDataFrame([], schema)
    dims = usual.dims
    rows = rows.filter(F.size("v") == dims)
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    kind = dict(rows.dtypes)["v"]
    # Of equal vectors k + 1 ids are enough for any result; Spark's group limit keeps no more from each task.
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    entries = C.staged(rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    total = entries.count()
    sample = entries.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    index = MultiIndex(_matrix(sample, "v", dims), total, k, target=target)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(_matrix(batch, "v", dims))
                yield pa.RecordBatch.from_arrays([pa.array(cells), column(batch, "v"), column(batch, "ids")], ["cell", "v", "ids"])

    indexed = C.staged(entries.mapInArrow(placed, f"cell long, v {kind}, ids array<long>"), "indexed")
    counts = np.zeros(len(index.one) * len(index.two), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # one row for each cell, CENTROIDS squared at most
        counts[r.cell] = r["count"]
    buckets, need = Buckets(counts, bucket), max(index.share * total, k + 1)

    def visit(batches):
        size = counts.tolist()
        for batch in batches:
            out = [[], [], [], []]
            for q, x in enumerate(_matrix(batch, "v", dims) if batch.num_rows else ()):
                at, cells = buckets.visits(traverse(-index.one @ x[: index.cut], -index.two @ x[index.cut :], size, need))
                cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                out[0].append(np.full(len(cut), q))
                out[1].append(at[cut])
                out[2].append(np.diff(np.append(cut, len(at))))
                out[3].append(cells)
            if out[0]:
                q, at, n, cells = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(at), column(batch, "id").take(pa.array(q)), column(batch, "v").take(pa.array(q)), lists(cells, n, pa.int64())], ["bucket", "id", "v", "cells"])

    asked = rows.filter(queries).select("id", "v").repartition(_tasks(spark))
    visited = C.staged(asked.mapInArrow(visit, f"bucket long, id long, v {kind}, cells array<long>"), "visits")
    tasks = C.staged(visited.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / visits).alias("tasks")), "tasks")
    tasks = F.broadcast(tasks) if tasks.count() * 32 <= C.BROADCAST_BYTES else tasks.hint("merge")
    own = spark.createDataFrame([(int(c), int(buckets.first[c]), int(buckets.parts[c])) for c in np.flatnonzero(counts)], "cell long, first long, parts long")
    dealt = indexed.join(F.broadcast(own), "cell").withColumn("bucket", F.col("first") + F.pmod(F.xxhash64("ids"), F.col("parts")))
    left = dealt.join(tasks, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "cell", "v", "ids")
    right = visited.join(tasks, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("tasks")).alias("task"), "id", "v", "cells")

    def ranked(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if entries.num_rows and queries.num_rows:
            x, cells, ids = _matrix(entries, "v", dims), entries["cell"].to_numpy(), entries["ids"].combine_chunks()
            order = np.argsort(cells, kind="stable")
            x, ids, cells = x[order], ids.take(pa.array(order)), cells[order]
            names, start = np.unique(cells, return_index=True)
            end, offsets, flat = np.append(start[1:], len(cells)), ids.offsets.to_numpy(), ids.flatten().to_numpy()
            step = max(1, SCORES // len(x))
            for at in range(0, queries.num_rows, step):
                part = queries.slice(at, step)
                y, asked = _matrix(part, "v", dims), part["cells"].combine_chunks()
                who, cell = np.repeat(np.arange(len(y)), np.diff(asked.offsets.to_numpy())), np.searchsorted(names, asked.flatten().to_numpy())
                known = (cell < len(names)) & (names[np.minimum(cell, len(names) - 1)] == asked.flatten().to_numpy())
                who, cell = who[known], cell[known]
                scores = np.full((len(y), len(x)), -np.inf)
                by = np.argsort(cell, kind="stable")
                for c, own in zip(*_runs(cell[by], who[by]), strict=True):
                    scores[own, start[c] : end[c]] = y[own] @ x[start[c] : end[c]].T
                if len(x) > k + 1:  # the query's own vector may be among them
                    least = np.partition(scores, len(x) - k - 1, axis=1)[:, len(x) - k - 1]
                    scores[scores < least[:, None] - 1e-9 * (1 + np.abs(least[:, None], where=np.isfinite(least[:, None]), out=np.zeros((len(y), 1))))] = -np.inf
                q, e = np.nonzero(scores > -np.inf)
                score = exact_scores(y[q], x[e])
                n = offsets[e + 1] - offsets[e]
                found, score, q = flat[ranges(offsets[e] - offsets[0], n)], np.repeat(score, n), part["id"].to_numpy()[np.repeat(q, n)]
                other = found != q
                found, score, q = found[other], score[other], q[other]
                by = np.lexsort((found, -score, q))
                found, score, q = found[by], score[by], q[by]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                for values, more in zip(out, (q[best], found[best], score[best]), strict=True):
                    values.append(more)
        values = [np.concatenate(v) if v else np.empty(0) for v in out]
        return pa.table([pa.array(values[0], pa.int64(), from_pandas=False), pa.array(values[1], pa.int64()), pa.array(values[2], pa.float64())] if out[0] else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.groupBy("bucket", "task").cogroup(right.groupBy("bucket", "task")).applyInArrow(ranked, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Each key of sorted keys, and its values."""
    if not len(keys):
        return [], []
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cut].tolist(), np.split(values, cut[1:])


def _tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
