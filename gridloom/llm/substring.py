"""Substring dedup of word sequences through an FM-index for each shard.

The distinct blocks of repeated grams (see windows) make up a shard, each with the number of its places, and their words one sequence with a separator
of its own after each block. Its Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with counts by 64-bit word, and the places as
running sums in suffix order. The shard's blocks are then streamed against it: from a word, backward search widens the match to the left while at least two
places have it. These matching statistics reach the window's length exactly at the ends of repeated windows, and those intervals are reported: first from
each block's end over all of the block, then, where that falls short, from the ends of the windows to the left of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .arrow import column, pieces, ranges, utf8
from .windows import Finder, merged_spans, with_spans

LENGTH, GRAM = 35, 11


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling; ends when all differ."""
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    n, width = len(sequence), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:]
        both = rank * (n + 1) + after + 1
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        width *= 2


class Wavelet:
    """A wavelet matrix: rank of any symbol before any place, in as many steps as symbols have bits."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels, self.size = max(1, int(symbols - 1).bit_length()), len(values)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, np.uint8)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        every = np.arange(symbols)
        self.base = self._down(every, np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            word = place >> 6
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            place = np.where(symbol >> level & 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before place[i]."""
        return self._down(symbol, place) - self.base[symbol]


class FMIndex:
    """Index of word sequences; symbols 0 to len(documents)-1 are their separators."""

    def __init__(self, documents: list[list[bytes]], places: np.ndarray | None = None):
        """places: how many places each document stands for."""
        self.sizes = np.array([len(d) for d in documents], np.int64)
        ids: dict[bytes, int] = {}
        for d in documents:
            for w in d:
                ids.setdefault(w, len(documents) + len(ids))
        self.ids, parts = ids, []
        for i, d in enumerate(documents):
            parts.append(np.array([*map(ids.__getitem__, d), i], np.int64))
        self.sequence = np.concatenate(parts) if parts else np.empty(0, np.int64)
        symbols = len(documents) + len(ids)
        order = suffix_array(self.sequence)
        self.wavelet = Wavelet(self.sequence[order - 1], max(symbols, 1))
        each = np.repeat(np.ones(len(documents), np.int64) if places is None else places, self.sizes + 1)
        self.places = np.concatenate([[0], np.cumsum(each[order])])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.sequence, minlength=symbols))])

    def matching(self, words: np.ndarray, room: np.ndarray, ends: np.ndarray, least: int, cap: int) -> np.ndarray:
        """For each end in the stream of symbols: the longest match that ends there, within room words and cap, and has `least` places."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.sequence), np.int64)
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for step in range(1, cap + 1):
            live = live[room[live] >= step]
            if not len(live):
                break
            symbol = words[ends[live] - step]
            a = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            b = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            good = self.places[b] - self.places[a] >= least
            live = live[good]
            low[live], high[live], length[live] = a[good], b[good], step
        return length


def repeats(blocks: list[bytes], gram: np.ndarray, several: np.ndarray, n: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first, end) of runs of windows of n words that have at least two places in the blocks. several: the block stands for more places."""
    seen: dict[tuple[int, bytes], int] = {}
    own = np.array([seen.setdefault(x, len(seen)) for x in zip(gram.tolist(), blocks, strict=True)], np.int64)
    index = FMIndex([b.split() for _, b in seen], np.bincount(own, 1 + several).astype(np.int64))
    begin, size = np.cumsum(index.sizes + 1) - index.sizes - 1, index.sizes
    length = index.matching(index.sequence, size, begin + size, 2, int(size.max()))
    found = length >= n
    whole = np.flatnonzero(found)
    rest = np.where(found, size - length, np.maximum(size - n + 1, 0))  # windows that the match does not reach
    block, first = np.repeat(np.arange(len(seen)), rest), ranges(np.zeros(len(seen), np.int64), rest)
    again = index.matching(index.sequence, np.full(len(block), n), begin[block] + first + n, 2, n) >= n
    block, first = block[again], first[again]
    block, first, end = np.concatenate([whole, block]), np.concatenate([(size - length)[whole], first]), np.concatenate([size[whole], first + n])
    by, count = np.argsort(own, kind="stable"), np.bincount(own)  # to each of the equal blocks
    at = ranges((np.cumsum(count) - count)[block], count[block])
    return by[at], np.repeat(first, count[block]), np.repeat(end, count[block])


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", finder: Finder | None = None) -> DataFrame:
    """One row for each row of df: id_col, n_words, n_removed, spans (flat, removed runs of words) and kept (the other words, joined by one
    space).

    Words are runs of anything but ASCII white space; null has none. A word goes if a window of 35 words that covers it has a word sequence
    that also starts anywhere else, in any row (a repeated row is another place) or in the same one. An empty table gives no rows; other
    columns are ignored.
    """
    finder = finder or Finder(LENGTH, GRAM, words=True, every=True)
    docs, n = C.keyed(df, id_col, text_col), finder.n
    found = with_spans(docs, finder.spans(docs, lambda blocks, gram, key, start, anchor, several: repeats(blocks, gram, several, n))).select("id", "text", "spans")
    schema = T.StructType([found.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.StringType())])

    def cut(batches):
        for batch in pieces(batches, "text"):
            size, gone, runs, kept = [], [], [], []
            for text, own in zip(utf8(column(batch, "text")), merged_spans(column(batch, "spans")), strict=True):
                words = text.split()
                edges = [0, *own, len(words)]
                left = [w for s, e in zip(edges[::2], edges[1::2], strict=True) for w in words[s:e]]
                size.append(len(words))
                gone.append(len(words) - len(left))
                runs.append(own)
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(kept, pa.string())], schema.names)

    return found.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_W = "[^\\x20\\x09-\\x0D]+"
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH} + 2)) AS p FROM d WHERE len(w) >= {LENGTH}),
k AS (SELECT doc_id, p, array_to_string(w[p:p + {LENGTH} - 1], ' ') AS s FROM p),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS n FROM k) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + {LENGTH})) AS q FROM r),
u AS (SELECT doc_id, unnest(w) AS y, generate_subscripts(w, 1) AS q FROM d),
g AS (SELECT u.doc_id, count(x.q) AS n, string_agg(y, ' ' ORDER BY u.q) FILTER (WHERE x.q IS NULL) AS s FROM u LEFT JOIN x ON u.doc_id = x.doc_id AND u.q = x.q GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
