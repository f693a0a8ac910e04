"""Suffix-array dedup of byte strings.

The blocks of repeated grams (see windows) form a shard's text. They are sorted as suffixes up to their ends, so equal blocks become neighbours;
of blocks that differ but share a gram, all window starts are sorted as suffixes of `n` bytes. The sort is a bottom-up mergesort in which
all runs merge side by side. Two suffixes are compared by prefix polynomial hashes: a binary search for the longest common extension takes
a logarithmic number of hash comparisons, then one byte decides. Neighbours in suffix order that share all their bytes are a repeated string; each
such pair is verified byte by byte, and a shard with a collision of hashes is sorted again by its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .arrow import column, pieces, ranges, utf8
from .windows import BYTE, Finder, Prefix, merged_spans, with_spans

LENGTH, GRAM = 100, 40


class Suffixes:
    """Suffixes of text, compared on their first `cap` bytes (or a number for each suffix). Starts need that many bytes of room."""

    def __init__(self, text: np.ndarray, cap: int, tokens: np.ndarray | None = None):
        self.text, self.cap = text, cap
        self.prefix = Prefix(BYTE[text] if tokens is None else tokens)

    def extension(self, a: np.ndarray, b: np.ndarray, cap=None) -> np.ndarray:
        """Length of the longest common prefix of suffixes a[i] and b[i], up to cap, by binary search on hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.cap if cap is None else cap)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix.of(a, mid) == self.prefix.of(b, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray, cap=None) -> np.ndarray:
        cap = self.cap if cap is None else cap
        shared = self.extension(a, b, cap)
        tie = shared >= cap
        shared = np.minimum(shared, cap - 1)
        return np.where(tie, or_equal, self.text[a + shared] < self.text[b + shared])

    def sort(self, starts: np.ndarray, group: np.ndarray, cap: np.ndarray | None = None) -> np.ndarray:
        """Order of starts by (group, suffix), stable; group must be sorted, and cap the same within a group."""
        n = len(starts)
        order, cap = np.arange(n), np.full(n, self.cap) if cap is None else cap
        begin = np.searchsorted(group, group)
        end = np.searchsorted(group, group, "right")
        place, widest = np.arange(n) - begin, int((end - begin).max()) if n else 0
        run = 1
        while run < widest:
            own = place // run
            low = begin + (own ^ 1) * run
            live = low < end
            low, high = np.minimum(low, end), np.minimum(low + run, end)
            base, left = low.copy(), own % 2 == 0
            at = np.flatnonzero(live & (low < high))
            while len(at):  # how many of the partner run come before each
                mid = (low[at] + high[at]) >> 1
                before = self.less(starts[order[mid]], starts[order[at]], ~left[at], cap[at])
                low[at] = np.where(before, mid + 1, low[at])
                high[at] = np.where(before, high[at], mid)
                at = at[low[at] < high[at]]
            target = begin + own // 2 * 2 * run + place % run + (low - base)
            merged_ = np.empty(n, np.int64)
            merged_[target] = order
            order, run = merged_, 2 * run
        return order

    def equal_bytes(self, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), bool)
        for i in range(0, len(a), 10_000):
            one, two, size = a[i : i + 10_000], b[i : i + 10_000], cap[i : i + 10_000]
            out[i : i + 10_000] = np.logical_and.reduceat(self.text[ranges(one, size)] == self.text[ranges(two, size)], np.cumsum(size) - size)
        return out

    def repeated(self, starts: np.ndarray, group: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """Which starts have the bytes of an earlier one of their group, compared byte by byte."""
        order = self.sort(starts, group, cap)
        a, b = order[:-1], order[1:]
        near = group[a] == group[b]
        a, b = a[near], b[near]
        same = self.extension(starts[a], starts[b], cap[b]) >= cap[b]
        if not self.equal_bytes(starts[a[same]], starts[b[same]], cap[b[same]]).all():
            order = np.array(sorted(range(len(starts)), key=lambda i: (group[i], self.text[starts[i] : starts[i] + cap[i]].tobytes(), i)), np.int64)
            a, b = order[:-1], order[1:]
            near = group[a] == group[b]
            a, b = a[near], b[near]
            same = self.equal_bytes(starts[a], starts[b], cap[b])
        out = np.zeros(len(starts), bool)
        out[b[same]] = True
        return out


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal rows."""
    return np.cumsum(np.concatenate([[0], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def repeats(blocks: list[bytes], gram: np.ndarray, key: np.ndarray, start: np.ndarray, anchor: np.ndarray, n: int = LENGTH, tokens=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first, end) of windows of n bytes that occur in an earlier place (key, start) of the blocks with the same gram, which then has
    the same place in the window."""
    size = np.array([len(b) for b in blocks], np.int64)
    text = np.frombuffer(b"".join(blocks), np.uint8)
    begin = np.cumsum(size) - size
    own = Suffixes(text, n, tokens(text) if tokens else None)
    by = np.lexsort((start, key, size, anchor, gram))  # the sorts are stable: of equal strings the earliest place comes first
    whole = np.zeros(len(blocks), bool)
    whole[by] = own.repeated(begin[by], _groups(gram[by], anchor[by], size[by]), size[by])
    left = np.flatnonzero(~whole)
    _, which, count = np.unique(gram[left], return_inverse=True, return_counts=True)
    left = left[count[which] > 1]
    windows = size[left] - n + 1
    block, first = np.repeat(left, windows), ranges(np.zeros(len(left), np.int64), windows)
    place = anchor[block] - first
    by = np.lexsort((start[block] + first, key[block], place, gram[block]))
    block, first, place = block[by], first[by], place[by]
    if len(block):
        group = _groups(gram[block], place)
        alone = np.bincount(group)[group] == 1
        block, first, group = block[~alone], first[~alone], group[~alone]
        later = own.repeated(begin[block] + first, group, np.full(len(block), n))
        block, first = block[later], first[later]
    whole = np.flatnonzero(whole)
    return np.concatenate([whole, block]), np.concatenate([np.zeros(len(whole), np.int64), first]), np.concatenate([size[whole], first + n])


def removed(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """docs (key, text) with spans of bytes to remove (see with_spans)."""
    finder = finder or Finder(LENGTH, GRAM, words=False, every=False)
    n = finder.n
    return with_spans(docs, finder.spans(docs, lambda blocks, gram, key, start, anchor, several: repeats(blocks, gram, key, start, anchor, n)))


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", finder: Finder | None = None) -> DataFrame:
    """One row for each row of df: id_col, n_bytes, n_removed, n_spans, spans (flat, maximal removed runs in bytes) and kept (binary).

    Texts are UTF-8 bytes; null counts as empty. A byte goes if a string of 100 bytes that covers it also starts earlier: in a document with a
    smaller id, or before in the same one. Rows that repeat an id, and null ids (last), follow each other in an order fixed by keyed().
    An empty table gives no rows; other columns are ignored.
    """
    found = removed(C.keyed(df, id_col, text_col), finder).select("id", "text", "spans")
    schema = T.StructType([found.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])

    def cut(batches):
        for batch in pieces(batches, "text"):
            texts, runs, out = utf8(column(batch, "text")), merged_spans(column(batch, "spans")), []
            for text, own in zip(texts, runs, strict=True):
                edges = [0, *own, len(text)]
                out.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if own else text)
            size = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(size, pa.int64()), pa.array([s - len(o) for s, o in zip(size, out, strict=True)], pa.int64()), pa.array([len(r) // 2 for r in runs], pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(out, pa.binary())], schema.names)

    return found.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, {2 * (LENGTH + 255)}) AS h FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(0, len(h) // 2, 256)) AS c FROM d)),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM
  (SELECT doc_id, c + i AS p, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT *, unnest(range(0, least(256, n - c - {LENGTH - 1}))) AS i FROM c))),
u AS (SELECT doc_id, c + i AS q, substr(h, 2 * i + 1, 2) AS b FROM (SELECT *, unnest(range(0, least(256, n - c))) AS i FROM c)),
g AS (SELECT u.doc_id, q, b, coalesce(max(CASE WHEN again THEN p END) OVER (PARTITION BY u.doc_id ORDER BY q) > q - {LENGTH}, false) AS gone FROM u LEFT JOIN k ON u.doc_id = k.doc_id AND q = p),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY q), false) AS opens FROM g),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(b, '' ORDER BY q) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
