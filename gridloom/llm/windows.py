"""Repeated windows of tokens over a whole corpus, exactly, without moving every window.

A window is `n` consecutive tokens (bytes or words) of one document. Its anchor is the k-gram in it with the smallest hash, so windows
with equal tokens have equal anchors at equal places, and a run of neighbouring windows shares one, about every (n-k)/2 tokens. A block is the tokens
of all windows of a run.

1. The anchors' grams are counted. A gram with one place has no repeated window; that is all that hashes decide.
2. The blocks of the other grams are sent with their bytes, dealt by gram, so equal windows always meet in one shard. Of blocks whose bytes are
   equal a batch sends the first.
3. A shard compares all its blocks, and where blocks with one gram differ all their windows (`resolve`: a suffix array, or an FM-index). Whatever
   is found was compared by its tokens.
4. A document's spans meet its text; documents without spans do not move.

A gram that a sample of documents shows to be common (a line of a third of all documents) is dealt out as single windows, each with its own
key, so its rows spread and equal ones are thinned out by batch; the sample only says where rows go, never what the result is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .arrow import column, merged, pieces, ranges, utf8
from .sieve import Sieve

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Repeated grams whose filter (two bytes each) is broadcast; with more, the anchors meet the grams and the documents in joins.
PLACES = 16_000_000
#: One in so many documents is sampled for common grams; a gram seen so often in the sample is common. Where more than MOST grams would be, the
#: number of sightings doubles until no more are: then each other gram has less than two in MOST of all anchors.
SAMPLE, COMMON, MOST = 16, 200, 1_000_000
#: Rows that a shard compares at once, if no gram has more.
CHUNK = 12_000
_LOW = (1 << 22) - 1
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64), 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for i, base in enumerate((BASE, INVERSE)):
            own = np.full(max(size, 1 << 16), base, np.uint64)
            own[0] = 1
            _powers[i] = np.cumprod(own, dtype=np.uint64)
    return _powers[0][:size], _powers[1][:size]


class Prefix:
    """Prefix polynomial hashes of a token array: the hash of any run of tokens in a few operations."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = powers(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def sliding(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


class Batch:
    """Texts as one array of tokens' hashes. Tokens are the bytes, or the words between ASCII white space."""

    def __init__(self, texts: list[bytes], words: bool):
        self.raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        if words:
            gap = SPACE[self.raw]
            edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
            if len(gap) and not gap[0]:
                edge = np.concatenate([[0], edge])
            self.first, self.last = edge[0::2], edge[1::2]  # each word's bytes
            self.start = np.searchsorted(self.first, begin)
            self.size = np.diff(np.append(self.start, len(self.first)))
            self.tokens = mix(Prefix(BYTE[self.raw]).of(self.first, self.last - self.first), 3)
        else:
            self.start, self.size = begin, size
            self.first, self.last = None, None
            self.tokens = BYTE[self.raw]

    def bytes_of(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and number of bytes of runs of tokens."""
        if self.first is None:
            return start, size
        return self.first[start], self.last[start + size - 1] - self.first[start]


class Anchors:
    """A batch's runs of windows with one anchor: doc, start (first window, in tokens of the batch), more (further windows), gram, anchor."""

    def __init__(self, batch: Batch, n: int, k: int, common: np.ndarray | None = None):
        self.batch, self.n = batch, n
        one = Prefix(batch.tokens)
        total, w = len(batch.tokens), n - k + 1
        long = np.flatnonzero(batch.size >= n)
        if total < n or not len(long):
            self.doc = self.start = self.more = self.anchor = np.empty(0, np.int64)
            self.gram = np.empty(0, np.uint64)
            return
        if total - k + 1 > _LOW:
            grams = _coarse(mix(one.sliding(k), 4), w)
        else:
            grams = mix(one.sliding(k), 4)
            grams = (grams & ~np.uint64(_LOW)) | np.arange(len(grams), dtype=np.uint64)
            grams = (_least(grams, w) & np.uint64(_LOW)).astype(np.int64)
        windows = batch.size[long] - n + 1
        place = ranges(batch.start[long], windows)
        doc = np.repeat(long, windows)
        anchor = grams[place]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(new)
        self.doc, self.start = doc[at], place[at]
        self.more = np.diff(np.append(at, len(place))) - 1
        anchor = anchor[at]
        self.gram = mix(one.of(anchor, k), 5)
        if common is not None and len(common):
            hot = common[np.minimum(np.searchsorted(common, self.gram), len(common) - 1)] == self.gram
            if hot.any():
                each = self.more[hot] + 1
                start, doc = ranges(self.start[hot], each), np.repeat(self.doc[hot], each)
                self.doc, self.start = np.concatenate([self.doc[~hot], doc]), np.concatenate([self.start[~hot], start])
                anchor = np.concatenate([anchor[~hot], start])
                self.more = np.concatenate([self.more[~hot], np.zeros(len(start), np.int64)])
                self.gram = np.concatenate([self.gram[~hot], mix(one.of(start, n), 6)])
        self.anchor = anchor


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    blocks = -(-len(v) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    before = np.minimum.accumulate(padded.reshape(blocks, w), axis=1).ravel()
    after = np.minimum.accumulate(padded.reshape(blocks, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - w + 1
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def _coarse(grams: np.ndarray, w: int) -> np.ndarray:
    """As above for arrays whose places don't fit 22 bits: in overlapping parts."""
    out, step = np.empty(len(grams) - w + 1, np.int64), _LOW - w
    for at in range(0, len(out), step):
        part = grams[at : at + step + w - 1]
        part = (part & ~np.uint64(_LOW)) | np.arange(len(part), dtype=np.uint64)
        got = (_least(part, w) & np.uint64(_LOW)).astype(np.int64) + at
        out[at : at + len(got)] = got
    return out


ROW = "gram long, key long, start long, anchor int, several boolean, bytes binary"


class Finder:
    """Finds windows that repeat. every: all places of a repeated window count, else all but the first (by key, then start)."""

    def __init__(self, n: int, k: int, words: bool, every: bool, batch: int = 1 << 20, sample: int = SAMPLE, common: int = COMMON, places: int = PLACES, most: int = MOST):
        self.n, self.k, self.words, self.every, self.batch = n, k, words, every, batch
        self.sample, self.common, self.places, self.most = sample, common, places, most

    def _anchored(self, batch: pa.RecordBatch, common) -> tuple[Batch, np.ndarray, Anchors, np.ndarray]:
        """A batch's tokens, its anchors, each one's key, and its start in its document."""
        own = Batch(utf8(column(batch, "text")), self.words)
        found = Anchors(own, self.n, self.k, common)
        key = column(batch, "key").to_numpy()[found.doc] if len(found.doc) else np.empty(0, np.int64)
        return own, key, found, found.start - own.start[found.doc]

    def _counted(self, docs: DataFrame, common=None) -> DataFrame:
        """(gram, n) of the anchors."""

        def count(batches):
            for batch in pieces(batches, "text", self.batch):
                gram, n = np.unique(self._anchored(batch, common and common.value)[2].gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

        return docs.select("key", "text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))

    def common_grams(self, docs: DataFrame) -> np.ndarray:
        """At most `most` of them, sorted."""
        drawn, least = docs.filter(F.pmod(F.xxhash64("key"), F.lit(self.sample)) == 0), self.common
        table = C.staged(self._counted(drawn).filter(F.col("n") >= least), "common")
        while table.filter(F.col("n") >= least).count() > self.most:
            least *= 2
        return np.sort(table.filter(F.col("n") >= least).select("gram").toArrow().column("gram").to_numpy().view(np.uint64))

    def spans(self, docs: DataFrame, resolve: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
        """docs (key, text) to (key, start, end): spans of repeated windows' tokens, which may overlap and repeat.

        resolve(blocks, gram, key, start, anchor, several): for blocks' bytes, their grams, the place of their first window, the gram's place in the block,
        and whether its batch has the block again: arrays (block, first, end) of runs of its windows that repeat.
        """
        spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        common = spark.sparkContext.broadcast(self.common_grams(docs))
        again = C.staged(self._counted(docs, common).filter("n > 1").select("gram"), "grams")
        count, docs = again.count(), docs.select("key", "text")
        if count <= self.places:
            bits, source = spark.sparkContext.broadcast(Sieve(again.select(F.col("gram").alias("h")), count).bits()), docs
        else:
            bits, source = None, docs.join(self._places(docs, common, again), "key")
        blocks = source.mapInArrow(self._blocks(common, bits), ROW)
        return C.staged(blocks.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_resolver(resolve), "key long, start long, end long"), "resolved")

    def _places(self, docs: DataFrame, common, again: DataFrame) -> DataFrame:
        """(key, places): the starts of a document's anchors whose gram is among these."""

        def every(batches):
            for batch in pieces(batches, "text", self.batch):
                _, key, found, start = self._anchored(batch, common.value)
                yield pa.RecordBatch.from_arrays([pa.array(found.gram.view(np.int64)), pa.array(key), pa.array(start)], ["gram", "key", "start"])

        found = docs.mapInArrow(every, "gram long, key long, start long").join(again.hint("merge"), "gram")
        return found.groupBy("key").agg(F.collect_list("start").alias("places"))

    def _blocks(self, common, bits):
        """bits: a filter of the repeated grams, broadcast, or None if each row has its places."""
        n, size = self.n, self.batch

        def scan(batches):
            for batch in pieces(batches, "text", size):
                own, key, found, start = self._anchored(batch, common.value)
                if bits:
                    at = np.flatnonzero(bits.value.has(found.gram))
                else:
                    places = column(batch, "places")
                    whose = np.repeat(column(batch, "key").to_numpy(), pc.list_value_length(places).to_numpy())
                    at = np.flatnonzero(_among(np.sort(_place(whose, places.flatten().to_numpy())), _place(key, start)))
                at = at[np.lexsort((start[at], key[at]))]
                byte, width = own.bytes_of(found.start[at], found.more[at] + n)
                raw, seen = own.raw, {}
                blocks = [raw[b : b + s].tobytes() for b, s in zip(byte.tolist(), width.tolist(), strict=True)]
                gram = found.gram[at].view(np.int64)
                first = np.array([seen.setdefault(x, i) for i, x in enumerate(zip(gram.tolist(), blocks, strict=True))], np.int64)
                later = first != np.arange(len(at))
                several = np.zeros(len(at), bool)
                several[first[later]] = True
                stay = np.flatnonzero(~later)
                yield _rows(gram[stay], key[at[stay]], start[at[stay]], (found.anchor - found.start)[at[stay]], several[stay], [blocks[i] for i in stay.tolist()])
                k, s, e = _runs(key[at[later]], start[at[later]], (start + found.more)[at[later]] + n)
                yield _rows(_place(k, s), k, s, e - s, np.zeros(len(k), bool), [None] * len(k))

        return scan


def _rows(gram, key, start, anchor, several, blocks) -> pa.RecordBatch:
    """Blocks; or spans, which have their length in anchor's place."""
    return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(key), pa.array(start), pa.array(anchor, pa.int32()), pa.array(several), pa.array(blocks, pa.binary())], ["gram", "key", "start", "anchor", "several", "bytes"])


def _runs(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans as runs: those of one owner that overlap or touch are one, if ends rise with starts."""
    if not len(owner):
        return owner, start, end
    by = np.lexsort((end, start, owner))
    owner, start, end = owner[by], start[by], end[by]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])]))
    return owner[first], start[first], np.maximum.reduceat(end, first)


def _among(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _place(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (mix(key.astype(np.uint64), 21) * np.uint64(BASE) + mix(start.astype(np.uint64), 22)).view(np.int64)


def grouped(batches, names: list[str], most: int = CHUNK) -> Iterator[list[np.ndarray]]:
    """Sorted rows as columns, in parts of about `most` that never cut a group of the first column."""
    held, size = [], 0
    for batch in batches:
        held.append([column(batch, c).to_numpy(zero_copy_only=False) for c in names])
        size += len(held[-1][0])
        if size >= most:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield [c[:cut] for c in rows]
            held = [[c[cut:] for c in rows]]
            size = len(held[0][0])
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _spans(key, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(start), pa.array(end)], ["key", "start", "end"])


def _resolver(resolve):
    def run(batches):
        for gram, key, start, anchor, several, blocks in grouped(batches, ["gram", "key", "start", "anchor", "several", "bytes"]):
            span = np.array([b is None for b in blocks.tolist()], bool)
            yield _spans(key[span], start[span], start[span] + anchor[span])
            gram, key, start, anchor, several, blocks = (v[~span] for v in (gram, key, start, anchor.astype(np.int64), several, blocks))
            _, own, count = np.unique(gram, return_inverse=True, return_counts=True)
            live = (count[own] > 1) | several  # another document's gram can pass the filter by chance
            gram, key, start, anchor, several, blocks = (v[live] for v in (gram, key, start, anchor, several, blocks))
            if len(gram):
                block, first, end = _runs(*resolve(blocks.tolist(), gram, key, start, anchor, several))
                yield _spans(key[block], start[block] + first, start[block] + end)

    return run


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with spans: an array of numbers, each a span's start * 2^32 and its length, or null. A document's spans are no more than its tokens.
    Only documents with spans shuffle."""
    own = C.staged(spans.groupBy("key").agg(F.collect_list(F.shiftleft("start", 32) + (F.col("end") - F.col("start"))).alias("spans")), "spans")
    tested = Sieve(own.select(F.xxhash64("key").alias("h")), own.count()).marked(docs, F.xxhash64("key"))
    hit = tested.filter("again").drop("again").join(own, "key", "left")
    return tested.filter(~F.col("again")).drop("again").withColumn("spans", F.lit(None).cast("array<bigint>")).unionByName(hit)


def merged_spans(spans: pa.Array) -> list[list[int]]:
    """with_spans' arrays as flat lists of the edges of maximal runs."""
    flat, out = spans.flatten().to_numpy(), []
    size = np.array([0 if n is None else n for n in pc.list_value_length(spans).to_pylist()], np.int64)
    ends = np.cumsum(size)
    for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
        start = flat[a:b] >> 32
        out.append(np.stack(merged(start, start + (flat[a:b] & 0xFFFFFFFF)), axis=1).ravel().tolist() if b > a else [])
    return out
