"""Benchmark decontamination as a prefix-filtered set join.

Each window of an item (`window` consecutive words; a shorter item is one window) is a set of shingles of three words. A document that
holds the window holds every one of its shingles, so the rarest one alone, by the count over all documents, is the prefix that must be
joined. A document position with a prefix shingle and a place of that shingle in an item make a candidate; bounds on what the document and
the item have left and right of it (length and position) drop those that cannot be whole windows; the others are compared word by word. Places of a
frequent shingle whose surroundings are equal, as in an item of repeated words, are one, with all their items; pairs are made and compared in chunks of bounded size.

The items are taken in blocks of bounded bytes, each broadcast; the documents are scanned twice for each block (counts, then the join) and
never shuffle. With one block, as for any usual benchmark, nothing is written in between.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .arrow import column, lists, merged, pieces, ranges, utf8

WINDOW, SHINGLE = 10, 3
#: Bytes of item text in one block; what is broadcast is a small multiple of it.
BLOCK_BYTES = 16 << 20
#: Places of one shingle beyond which equal surroundings are looked for, places that are compared at a time for that, and pairs that a task holds.
MANY, SLICE, PAIRS = 32, 100_000, 1 << 18
#: A to Z become lower case; what is no word character becomes a space. Bytes of 0x80 and above belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Block:
    """The index of some items: ids of their words, their shingles, and after `choose` the prefix shingles with their places."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.names, texts = window, [], []
        for name, text in items:
            if found := words(text):
                self.names.append(name)
                texts.append(found)
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = window + np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]  # a gap of one between items
        self.ids = np.full(int(self.size.sum()) + len(texts) + 2 * window, -2, np.int64)
        for s, t in zip(self.start, texts, strict=True):
            self.ids[s : s + len(t)] = [self.vocabulary[w] for w in t]
        self.length = np.minimum(self.size, window)  # words in a window of the item
        self.order = np.minimum(self.size, SHINGLE)  # words in its shingles
        self.pairs = self.code(self.ids, 2)
        self.pairs = np.unique(self.pairs[self.pairs >= 0])
        self.codes: dict[int, np.ndarray] = {}  # by words in a shingle, the sorted distinct shingles
        for k in sorted(set(self.order.tolist())):
            self.codes[k] = np.unique(self.code(self.ids, k)[self.places(k)[1]])

    def code(self, ids: np.ndarray, k: int) -> np.ndarray:
        """A number for the shingle that starts at each place; -1 where a word isn't in the vocabulary."""
        n = max(0, len(ids) - k + 1)
        out, good = np.zeros(n, np.int64), np.ones(n, bool)
        wide = (len(self.vocabulary) + 1) ** k >> 63  # too many words for a third power: pairs get numbers of their own
        for j in range(k):
            part = ids[j : j + n]
            if wide and j == 2:
                at = np.minimum(np.searchsorted(self.pairs, out), len(self.pairs) - 1)
                good &= self.pairs[at] == out
                out = at
            out = out * (len(self.vocabulary) + 1) + part
            good &= part >= 0
        return np.where(good, out, -1)

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Item and place of each shingle of k words."""
        own = np.flatnonzero(self.order == k)
        counts = self.size[own] - k + 1
        return np.repeat(own, counts), ranges(self.start[own], counts)

    def choose(self, seen: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle (the first of equally rare ones). seen: each code's count over the documents."""
        self.prefix = {}
        for k, codes in self.codes.items():
            item, place = self.places(k)
            at = np.searchsorted(codes, self.code(self.ids, k)[place])
            rank = np.full(len(self.ids), np.iinfo(np.int64).max)
            order = np.lexsort((np.arange(len(codes)), seen[k]))
            rank_of = np.empty(len(codes), np.int64)
            rank_of[order] = np.arange(len(codes))
            rank[place] = rank_of[at]
            own = np.flatnonzero(self.order == k)
            windows = self.size[own] - self.length[own] + 1
            first, span = ranges(self.start[own], windows), np.repeat(self.length[own] - k + 1, windows)
            best = first.copy()
            for j in range(1, self.window - k + 1):
                better = (j < span) & (rank[np.minimum(first + j, len(rank) - 1)] < rank[best])
                best = np.where(better, first + j, best)
            chosen = np.unique(best)
            which = np.searchsorted(self.start, chosen, "right") - 1
            code = self.code(self.ids, k)[chosen]
            order = np.argsort(code, kind="stable")
            code, chosen, which = code[order], chosen[order], which[order]
            first, members = self._distinct(code, chosen, which, k)
            keys, begin, counts = np.unique(code[first], return_index=True, return_counts=True)
            self.prefix[k] = (keys, begin, counts, chosen[first], which[first], members)

    def _distinct(self, code: np.ndarray, place: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Of places sorted by code those that stand for all with the same surroundings (the words that a window with the shingle can reach, within the item, and the
        window's length), in the same order, and the items of each: all in one array, and where each one's begin."""
        stands = np.arange(len(code))
        counts = np.bincount(np.cumsum(np.append(0, code[1:] != code[:-1]))[: len(code)])
        many = np.flatnonzero(np.repeat(counts, counts) > MANY) if len(code) else stands
        reach = np.arange(1 - self.window, k + self.window - 1)
        for i in range(0, len(many), SLICE):
            own = many[i : i + SLICE]
            at = place[own, None] + reach
            inside = (at >= self.start[item[own], None]) & (at < (self.start + self.size)[item[own], None])
            around = np.where(inside, self.ids[np.clip(at, 0, len(self.ids) - 1)], -2)
            around = np.concatenate([code[own, None], self.length[item[own], None], around], axis=1)
            _, first, again = np.unique(around, axis=0, return_index=True, return_inverse=True)
            stands[own] = own[first[again.ravel()]]
        first, again = np.unique(stands, return_inverse=True)
        both = np.unique(again * max(1, len(self.names)) + item)
        return first, (both % max(1, len(self.names)), np.searchsorted(both, np.arange(len(first) + 1) * max(1, len(self.names))))

    def word_ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' word ids in one array with gaps, each text's start in it, and its number of words."""
        get, parts, sizes, gap = self.vocabulary.get, [np.full(self.window, -1, np.int64)], [], np.full(self.window, -1, np.int64)
        for text in texts:
            found = words(text)
            parts += [np.fromiter(map(get, found, repeat(-1)), np.int64, len(found)), gap]
            sizes.append(len(found))
        size = np.array(sizes, np.int64)
        return np.concatenate(parts), self.window + np.cumsum(size + self.window) - size - self.window, size

    def count(self, texts: list[bytes], totals: dict[int, np.ndarray]) -> None:
        ids, _, _ = self.word_ids(texts)
        for k, codes in self.codes.items():
            got = self.code(ids, k)
            got = got[got >= 0]
            at = np.minimum(np.searchsorted(codes, got), len(codes) - 1)
            at = at[codes[at] == got]
            totals[k] += np.bincount(at, minlength=len(codes))

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; then hit runs, none touching: text, first word, end; then what items are found: text and item, each pair once."""
        ids, start, size = self.word_ids(texts)
        runs, pairs, n_items = [np.empty((2, 0), np.int64)], [np.empty(0, np.int64)], max(1, len(self.names))
        for k, (keys, begin, counts, chosen, which, (members, first_of)) in self.prefix.items():
            code = self.code(ids, k)
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            places = np.flatnonzero((code >= 0) & (keys[at] == code))
            ends, done = np.cumsum(counts[at[places]]), 0
            while done < len(places):
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
                own, done = places[done:upto], upto
                n = counts[at[own]]
                post = ranges(begin[at[own]], n)
                p, first, end = self._whole(ids, start, size, np.repeat(own, n), chosen[post], which[post], k)
                runs.append(np.stack(merged(first, end)))
                doc, group = np.searchsorted(start, first, "right") - 1, post[p]
                both = np.unique(doc * len(chosen) + group)
                doc, group = both // len(chosen), both % len(chosen)
                held = first_of[group + 1] - first_of[group]
                pairs.append(np.unique(np.repeat(doc, held) * n_items + members[ranges(first_of[group], held)]))
        first, end = merged(*np.concatenate(runs, axis=1))
        found = np.unique(np.concatenate(pairs))
        doc = np.searchsorted(start, first, "right") - 1
        return size, doc, first - start[doc], end - start[doc], found // n_items, found % n_items

    def _whole(self, ids, start, size, p, x, item, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of a text's place p and an item's place x those that lie in a common window: their numbers, and first word and end of what agrees, within reach."""
        doc, nth = np.searchsorted(start, p, "right") - 1, np.arange(len(p))
        long, reach = self.length[item], self.length[item] - k
        left = np.minimum(np.minimum(p - start[doc], x - self.start[item]), reach)
        right = np.minimum(np.minimum(start[doc] + size[doc] - p, self.start[item] + self.size[item] - x) - k, reach)
        good = left + right + k >= long  # room for a whole window on both sides
        p, x, nth, left, right, long = (v[good] for v in (p, x, nth, left, right, long))
        before, after = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for grown, room, sign, edge in ((before, left, -1, 0), (after, right, 1, k - 1)):
            live = np.arange(len(p))
            for j in range(1, self.window):
                live = live[room[live] >= j]
                live = live[ids[p[live] + sign * (j + edge)] == self.ids[x[live] + sign * (j + edge)]]
                grown[live] += 1
        good = before + after + k >= long
        return nth[good], (p - before)[good], (p + after + k)[good]


def _blocks(items: DataFrame, most: int):
    block, size = [], 0
    for name, text in items.toLocalIterator():
        text = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append(("null" if name is None else name, text))
        size += len(text)
    yield block


def overlaps(rows: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows (with a string column text, which goes) and n_words, n_hit, spans (first word and end of each hit run, flat) and items (the
    names of the items found, sorted as strings). items: columns name (string) and text. No other columns' names may be n_words, n_hit,
    spans or items."""
    carried = [c for c in rows.columns if c != "text"]
    fields = [(c, rows.schema[c]) for c in carried]
    for last, items_now in _ends(_blocks(items.select("name", "text"), block_bytes)):
        block = Block(items_now, window)
        rows = _scan(rows, _counted(rows, block), carried, keep_text=not last)
        if not last:
            rows = C.staged(rows, "overlaps")
    assert [f.name for _, f in fields] == carried
    return rows


def _ends(values):
    """Each value with whether it is the last."""
    kept, any_ = None, False
    for v in values:
        if any_:
            yield False, kept
        kept, any_ = v, True
    yield True, kept


def _counted(rows: DataFrame, block: Block) -> Block:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        own = shared.value
        totals = {k: np.zeros(len(c), np.int64) for k, c in own.codes.items()}
        for batch in pieces(batches, "text", 1 << 19):
            own.count(utf8(column(batch, "text")), totals)
        for k, v in totals.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(v[at])], ["k", "code", "n"])

    totals = {k: np.zeros(len(c), np.int64) for k, c in block.codes.items()}
    if block.names:
        got = rows.select("text").mapInArrow(count, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n")).toArrow()
        k, code, n = (got.column(c).to_numpy() for c in ("k", "code", "n"))
        for key, v in totals.items():
            v[code[k == key]] = n[k == key]
    shared.unpersist()
    block.choose(totals)
    return block


def _scan(rows: DataFrame, block: Block, carried: list[str], keep_text: bool) -> DataFrame:
    """rows with the words, hits, spans and items of this block, added to those of earlier blocks. A null text has no words; very long ones, and repeated words on
    both sides, take memory for one chunk of pairs at a time."""
    from pyspark.sql import types as T

    shared, before = rows.sparkSession.sparkContext.broadcast(block), "spans" in rows.columns
    carried = [c for c in carried if c not in ("n_words", "n_hit", "spans", "items")] + ["text"] * keep_text
    kinds = {f.name: f for f in rows.schema}
    schema = T.StructType([*[kinds[c] for c in carried], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def scan(batches):
        own = shared.value
        for batch in pieces(batches, "text", 1 << 19):
            size, doc, first, end, found_in, item = own.hits(utf8(column(batch, "text")))
            names = [set() for _ in size]
            cut = np.searchsorted(doc, np.arange(len(size) + 1))
            for d, x in zip(found_in.tolist(), item.tolist(), strict=True):
                names[d].add(own.names[x])
            earlier = [column(batch, c).to_pylist() for c in ("spans", "items")] if before else None
            flat, counts, hit = [], [], []
            for i in range(len(size)):
                a, b = first[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]]
                if earlier:
                    names[i].update(earlier[1][i])
                    old = np.array(earlier[0][i], np.int64)
                    a, b = merged(np.concatenate([a, old[::2]]), np.concatenate([b, old[1::2]]))
                flat.append(np.stack([a, b], 1).ravel())
                counts.append(2 * len(a))
                hit.append(int((b - a).sum()))
            names = [sorted(x) for x in names]
            flat = np.concatenate(flat) if flat else np.empty(0, np.int64)
            found = lists([x for v in names for x in v], [len(v) for v in names], pa.string())
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in carried], pa.array(size), pa.array(hit, pa.int64()), lists(flat.astype(np.int32), counts, pa.int32()), found], schema.names)

    return rows.mapInArrow(scan, schema)


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(C.col(item_id).cast("string").alias("name"), C.col(item_text).cast("string").alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_hit, n_items, items (array), spans (flat word positions), contaminated.

    Words are those of `words` after lower-casing A to Z. A word is hit when it lies in an occurrence of an item's window. Null and empty
    texts have no words and no hits; items without words have no windows; an item without an id counts as item "null", and items that share
    an id are one. Repeated documents each get their row. An empty benchmark hits nothing; no documents give no rows.
    """
    rows = docs.select(C.col(id_col).alias("id"), C.col(text_col).cast("string").alias("text"))
    found = overlaps(rows, _items(benchmark, item_id, item_text), window, block_bytes)
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no word is hit (see contamination)."""
    rows = C.packed(docs, id_col, text_col).select("row", F.col("text").cast("string").alias("text"))
    return overlaps(rows, _items(benchmark, item_id, item_text), window, block_bytes).filter("n_hit = 0").select("row.*")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ip AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM ip),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, p, dw.n FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM dp) dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
