"""Best-fit packing of token pieces into sequences, as vector bin packing.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces of one length are alike, so the plan
is made on the driver from the number of pieces of each length alone (at most `tokens` numbers, however large the corpus): lengths go in
falling order, bins in the same state are one group, and for each length the feasible group with the best score takes pieces until it has
no room under one of the capacities. The score is the smallest weighted norm of what would remain, or the largest weighted dot product of
the piece and what is left. The plan says where the pieces of a length, in their order, go; every piece finds its own place in it.

Pieces get their order from the task that made them (in the written piece table) and that task's place among all tasks, so no length,
however frequent, meets in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .arrow import column, pieces, trim, utf8
from .tokens import Encoder

LENGTH = 2048
END = 0


def plan(counts: dict[int, int], tokens: int = LENGTH, documents: int | None = None, attention: int | None = None, weights=(1.0, 0.01, 0.01), rule: str = "norm") -> dict[str, np.ndarray]:
    """Segments (length, rank, bin, each, offset): the pieces of this length from this rank on, `each` to a bin, fill bins from `bin` on at
    this offset. counts: pieces of each length. Without a bound, documents and attention get capacities that tokens alone imply."""
    capacity = np.array([tokens, documents or tokens, attention or tokens * tokens], np.float64)
    scale = np.asarray(weights, np.float64) / capacity**2
    left, first, many = np.empty((0, 3)), np.empty(0, np.int64), np.empty(0, np.int64)
    bins, out = 0, []
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        need = np.array([length, 1.0, float(length) * length])
        if not 0 < length <= tokens or (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        rest, rank = counts[length], 0
        open_ = (left >= need).all(axis=1)
        at = np.flatnonzero(open_)
        if len(at):
            score = ((left[at] - need) ** 2 * scale).sum(1) if rule == "norm" else -(left[at] * need * scale).sum(1)
            at = at[np.lexsort((first[at], score))]
        put = []
        for g in at.tolist():
            if not rest:
                break
            each = int((left[g] // need).min())
            used, over = divmod(rest, each)
            if used >= many[g]:
                used, over = int(many[g]), 0
            for n, k, skip in ((used, each, 0), (1, over, used)):
                if n and k:
                    put.append((g, n, k, skip))
                    out.append((length, rank, first[g] + skip, k, tokens - left[g, 0]))
                    rank, rest = rank + n * k, rest - n * k
        gone, more = np.zeros(len(many), np.int64), []
        for g, n, k, skip in put:
            gone[g] += n
            more.append((left[g] - k * need, first[g] + skip, n))
        first, many = first + gone, many - gone
        if rest:
            each = int((capacity // need).min())
            for n, k in ((rest // each, each), (1, rest % each)):
                if n and k:
                    out.append((length, rank, bins, k, 0))
                    more.append((capacity - k * need, bins, n))
                    rank, bins = rank + n * k, bins + n
        if more:
            left = np.concatenate([left, np.array([m[0] for m in more])])
            first = np.concatenate([first, np.array([m[1] for m in more], np.int64)])
            many = np.concatenate([many, np.array([m[2] for m in more], np.int64)])
        keep = (many > 0) & (left[:, :2] >= 1).all(axis=1) & (left[:, 2] >= 1)
        left, first, many = left[keep], first[keep], many[keep]
    rows = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "each", "offset"), rows.T, strict=True)) | {"bins": np.array([bins])}


def token_pieces(rows: DataFrame, tokenizer: str, tokens: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """rows (id, text) as pieces: id, piece, start, length, ids_crc32, shard and local (the task, and the number in it among pieces of this
    length), and ids if kept."""
    kind = T.StructType([rows.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("local", T.LongType())])
    if keep_ids:
        kind = kind.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches):
        from pyspark import TaskContext

        shard, seen, encoder = TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64), Encoder(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in pieces(batches, "text", 1 << 20):
            raw = [x + end for x in encoder.encode(utf8(column(batch, "text")))]
            size = np.array([len(x) // 4 for x in raw], np.int64)
            n = -(-size // tokens)
            doc = np.repeat(np.arange(len(raw)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * tokens
            length = np.minimum(size[doc] - start, tokens)
            parts = [memoryview(raw[d])[4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            crc = np.array([zlib.crc32(p) for p in parts], np.int64)
            order = np.argsort(length, kind="stable")
            runs, begin, count = np.unique(length[order], return_index=True, return_counts=True)
            local = np.empty(len(doc), np.int64)
            local[order] = np.arange(len(doc)) - np.repeat(begin, count) + np.repeat(seen[runs], count)
            seen[runs] += count
            out = [column(batch, "id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), shard, np.int32)), pa.array(local)]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, kind.names)
        del encoder
        trim()

    return rows.mapInArrow(cut, kind)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = LENGTH, documents: int | None = None, attention: int | None = None, weights=(1.0, 0.01, 0.01), rule: str = "norm", keep_ids: bool = False) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and then one 0; null and empty texts are that 0 alone. Only documents over `tokens` are cut. Sequences are dense,
    offsets have no gaps, and no sequence exceeds tokens, documents (pieces) or attention (sum of squared lengths). Repeated rows are packed
    each; null ids stay null; an empty table gives no rows. A tighter capacity than one full piece needs raises ValueError.
    """
    rows = df.select(C.col(id_col).alias("id"), C.col(text_col).cast("string").alias("text"))
    made = C.staged(token_pieces(rows, tokenizer, tokens, keep_ids), "pieces")
    counts = C.staged(made.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("shard", "length", F.coalesce("base", F.lit(0)).alias("base"))
    before = F.broadcast(before) if counts.count() * 64 <= C.BROADCAST_BYTES else before
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `tokens` rows
    found = plan(totals, tokens, documents, attention, weights, rule)
    shared = df.sparkSession.sparkContext.broadcast(found)
    ranked = made.join(before, ["shard", "length"]).withColumn("rank", F.col("local") + F.col("base")).drop("shard", "local", "base")

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        p = shared.value
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(p["length"].astype(np.int64) << 48 | p["rank"], length << 48 | rank, "right") - 1
        nth = rank - p["rank"][at]
        sequence, offset = p["bin"][at] + nth // p["each"][at], p["offset"][at] + nth % p["each"][at] * length
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    # Only length and rank go to Python: the ids stay where they are.
    placed = ranked.withColumn("place", F.arrow_udf(place, "sequence_id long, offset long")("length", "rank"))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "place.sequence_id", "place.offset")
