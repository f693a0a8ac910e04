"""Katz backoff language model: word bigrams that back off to unigrams and to one unknown word.

Counts up to K are discounted by Good-Turing; what that frees in a context is spread over the words that never followed it, in proportion to
their lower-order probability, so each context's distribution over the known words and the unknown one sums to one. A context without any
discounted count frees the share of one count more.

Counting and scoring move pairs of words in packed arrays, dealt to parts by a hash range: a pair goes with its second word, so the part
that has the word's pairs also knows its count. Words, contexts and pairs above a frequency that bounds their number (HOT slots) are broadcast
instead: pairs with a frequent second word are dealt by the pair, so no word's pairs gather in one part, and tokens whose pair, word and
context are all frequent are scored where they are read. The model is a table of parts in the shared folder (pairs and words), and one
of contexts; scoring evaluates a token at its pair's part, and backs off to the word there and to its context's part.

Words are 64-bit hashes (XXH64-like, collisions are about the square of the vocabulary in 2^65).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .arrow import column, pieces, utf8
from .windows import Batch, mix

K = 5
#: Slots (powers of two) for frequent words and contexts, and for frequent pairs; at most half as many entries are offered.
WORD_BITS, PAIR_BITS = 20, 21
#: Tokens that a task gathers before it sends them, and tokens to a part.
GATHER, PART = 750_000, 1_000_000
RARE = np.uint64(1 << 63)
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), ord(a.dtype.char))]], "<i8")
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2), 8 + 16 * n, []
    for size, kind in head.tolist():
        out.append(np.frombuffer(raw, chr(kind), size, at))
        at += out[-1].nbytes
    return out


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(mix(one, 11) * np.uint64(0x9E3779B97F4A7C15) + two, 12)


def planes(ids: np.ndarray) -> np.ndarray:
    """Sorted numbers as the bytes of their differences, the lowest bytes first, which compress to what differs."""
    steps = np.diff(ids, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def unplanes(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in four bytes each if all fit, else in eight."""
    return n.astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return [keys[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values]]


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key in the sorted keys, or 0."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Hot:
    """A broadcast table of bounded size: each key has one slot, the first offered key keeps it, and the others are not hot.

    It has at most 2^bits slots, and no more than four for each key; only the keys and values travel."""

    def __init__(self, bits: int, keys: np.ndarray, *values: np.ndarray):
        self.bits = min(bits, max(4, int(4 * len(keys)).bit_length()))
        _, first = np.unique(keys & np.uint64((1 << self.bits) - 1), return_index=True)
        self.own = [keys[first], *[v[first] for v in values]]
        self._fill()

    def _fill(self):
        self.mask = np.uint64((1 << self.bits) - 1)
        slot = (self.own[0] & self.mask).astype(np.int64)
        self.slots = [np.zeros(1 << self.bits, v.dtype) for v in self.own]
        for table, v in zip(self.slots, self.own, strict=True):
            table[slot] = v

    def __getstate__(self):
        return self.bits, self.own

    def __setstate__(self, state):
        self.bits, self.own = state
        self._fill()
        self.own = None  # a worker only looks up

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """Whether each key is hot, and its values."""
        slot = (keys & self.mask).astype(np.int64)
        return [self.slots[0][slot] == keys, *[v[slot] for v in self.slots[1:]]]

    def pair_ids(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A number for each pair: both words' slots if both are hot, else a hash with the top bit set."""
        a, b = (before & self.mask).astype(np.int64), (word & self.mask).astype(np.int64)
        hot = (self.slots[0][a] == before) & (self.slots[0][b] == word)
        return np.where(hot, b.astype(np.uint64) << np.uint64(24) | a.astype(np.uint64), pair_hash(before, word) | RARE)

    def words_of(self, ids: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both words of sorted pair ids; before and word are those of the ids with the top bit set, which come last."""
        hot = ids[: len(ids) - len(before)]
        a, b = (hot & np.uint64((1 << 24) - 1)).astype(np.int64), (hot >> np.uint64(24)).astype(np.int64)
        return np.concatenate([self.slots[0][a], before]), np.concatenate([self.slots[0][b], word])


@dataclass
class Discount:
    """Good-Turing discounts of counts 1 to K, from how many things have counts 1 to K + 1."""

    of: list[int]
    factor: np.ndarray = field(init=False)

    def __post_init__(self):
        n = [0, *self.of]
        d = np.ones(K + 1)
        common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            if n[r] and common < 1:
                own = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                d[r] = own if 0 < own < 1 else 1.0
        self.factor = d

    def counts(self, c: np.ndarray) -> np.ndarray:
        return c * self.factor[np.where((c >= 1) & (c <= K), c, 0).astype(np.int64)]

    def freed(self, small: np.ndarray) -> np.ndarray:
        """Count that is free, by how many things have counts 1 to K (last axis)."""
        return (small * np.arange(1, K + 1) * (1 - self.factor[1:])).sum(axis=-1)


@dataclass
class Model:
    table: DataFrame  # part, kind, data: pairs and rare words
    contexts: DataFrame  # part, data: contexts
    parts: int
    tokens: int
    types: int
    words: Discount
    pairs: Discount
    unknown: float
    over: float  # what the unigrams' counts are divided by
    hot_words: Hot
    hot_pairs: Hot
    hot_contexts: Hot

    def word(self, count: np.ndarray) -> np.ndarray:
        """Unigram probability of a word with this count; 0 is the unknown word."""
        return np.where(count > 0, self.words.counts(count) / self.over, self.unknown)

    def context(self, total: np.ndarray, small: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a context's counts are divided by, and its backoff weight."""
        return _context(self.pairs, total, small, lower)


def _context(pairs: Discount, total, small, lower):
    free = pairs.freed(small)
    over = np.where(free > 0, total, total + 1.0)
    free = np.where(free > 0, free, 1.0)
    return over, free / over / (1 - lower)


class _Stream:
    """Tokens of texts, with the word before each: keys' row numbers, before, word."""

    def __init__(self, texts: list[bytes]):
        batch = Batch([t.lower() for t in texts], words=True)
        size = batch.size + 1
        ends = np.cumsum(size)
        self.size, self.doc = size, np.repeat(np.arange(len(texts)), size)
        self.word = np.full(int(ends[-1]) if len(ends) else 0, END)
        inner = np.ones(len(self.word), bool)
        inner[ends - 1] = False
        self.word[inner] = batch.tokens
        self.before = np.concatenate([[BEGIN], self.word[:-1]]) if len(self.word) else self.word
        self.before[ends - size] = BEGIN


def _blobs(part: np.ndarray, arrays: list[np.ndarray], kind: int) -> list[tuple[int, int, bytes]]:
    """Rows (part, kind, packed arrays); part must be sorted."""
    own, first = np.unique(part, return_index=True)
    ends = np.append(first[1:], len(part))
    return [(int(p), kind, packed(*[a[s:e] for a in arrays])) for p, s, e in zip(own.tolist(), first.tolist(), ends.tolist(), strict=True)]


def _by_part(part: np.ndarray):
    """Each part with the places of its rows, in their order."""
    order = np.argsort(part, kind="stable")
    own, first = np.unique(part[order], return_index=True)
    yield from zip(own.tolist(), np.split(order, first[1:]), strict=True)


BLOB = "part int, kind int, data binary"
COUNTS, PAIRS, CONTEXTS, EVENTS, ASKS, SCORES, CHECKS = range(7)


def _table(rows, names=("part", "kind", "data")) -> pa.Table:
    kinds = {"part": pa.int32(), "kind": pa.int32(), "data": pa.binary(), "stats": pa.list_(pa.int64())}
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], list(names))


def _held(table: pa.Table, kind: int) -> list[list[np.ndarray]]:
    return [unpacked(d) for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True) if k == kind]


def _joined(held: list[list[np.ndarray]], like: str) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.empty(0, k) for k in like]


def _batched(table: pa.Table):
    yield from table.combine_chunks().to_batches()


def _histogram(counts: np.ndarray) -> list[int]:
    """How many counts are 1 to K + 1, the number and sum of all, and how many are 2^j or more."""
    small = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]
    return [*small.tolist(), len(counts), int(counts.sum()), *[int((counts >= 1 << j).sum()) for j in range(40)]]


def _sums(table: DataFrame) -> list[int]:
    n = K + 3 + 40
    row = table.filter("stats IS NOT NULL").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [int(x or 0) for x in row]


def _least(stats: list[int], most: int) -> int:
    """The smallest power of two such that at most `most` counts reach it."""
    return 1 << next((j for j, n in enumerate(stats[K + 3 :]) if n <= most), 62)


def _collected(table: DataFrame, kind: int, pick) -> list[np.ndarray]:
    """Entries of the table's parts that pick() selects, at the driver; their number must be bounded by the caller."""

    def run(batches):
        for batch in batches:
            for k, data in zip(column(batch, "kind").to_pylist(), column(batch, "data").to_pylist(), strict=True):
                if k == kind:
                    yield pa.RecordBatch.from_arrays([pa.array([packed(*pick(unpacked(data)))], pa.binary())], ["data"])

    return [np.concatenate(c) for c in zip(*[unpacked(d) for d in table.select("kind", "data").mapInArrow(run, "data binary").toArrow().column("data").to_pylist()], strict=True)]


def _hot(bits: int, found: list[np.ndarray], like: str, first: np.uint64 | None = None) -> Hot:
    """The entries by falling second column; first is a key that comes before all, with zeros."""
    found = found or [np.empty(0, k) for k in like]
    order = np.argsort(-found[1].astype(np.int64), kind="stable")
    own = [f[order].astype(k) for f, k in zip(found, like, strict=True)]
    if first is not None:
        own = [np.concatenate([np.array([first if i == 0 else 0], v.dtype), v]) for i, v in enumerate(own)]
    return Hot(bits, *own)


def train(docs: DataFrame, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS, gather: int = GATHER, part: int = PART) -> Model:
    """The model of docs (a string column text; null is empty). No documents give a model in which each word is unknown."""
    spark = docs.sparkSession
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("text")

    def count(batches):
        held, size = [], 0

        def send():
            word, n = summed(*map(np.concatenate, zip(*held, strict=True)))
            return next(_batched(_table(_blobs(part_of(word, floor), [word, n], COUNTS))))

        for batch in pieces(batches, "text", 1 << 20):
            word, n = np.unique(_Stream(utf8(column(batch, "text"))).word, return_counts=True)
            held.append((word, n))
            size += len(word)
            if size > gather:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    def add(key, table):
        word, n = summed(*_joined(_held(table, COUNTS), "Ql"))
        return _table([(key[0].as_py(), COUNTS, packed(word, n), _histogram(n))], ("part", "kind", "data", "stats"))

    unigrams = C.staged(docs.mapInArrow(count, BLOB).groupBy("part").applyInArrow(add, BLOB + ", stats array<long>"), "unigrams")
    stats = _sums(unigrams)
    tokens, types, words = stats[K + 2], stats[K + 1], Discount(stats[: K + 1])
    parts = max(floor, -(-tokens // part))
    least = _least(stats, 1 << word_bits - 1)
    hot_words = _hot(word_bits, _collected(unigrams, COUNTS, lambda a: [x[a[1] >= least] for x in a]), "Ql", BEGIN)
    C.release(unigrams)
    free = float(words.freed(np.array(stats[:K], np.int64)))
    over, unknown = (tokens, free / tokens) if free else (tokens + 1, 1 / (tokens + 1))
    shared = spark.sparkContext.broadcast(hot_words)

    def pairs(batches):
        held, size = [], 0

        def send():
            before, word = map(np.concatenate, zip(*held, strict=True))
            ids = shared.value.pair_ids(before, word)
            ids, at, n = np.unique(ids, return_index=True, return_counts=True)
            before, word = before[at], word[at]
            part = part_of(np.where(shared.value.find(word)[0], mix(ids, 14), word), parts)
            rows = []
            for p, own in _by_part(part):
                rare = own[ids[own] >= RARE]
                rows.append((p, PAIRS, packed(planes(ids[own]), narrow(n[own]), before[rare], word[rare])))
            return next(_batched(_table(rows)))

        for batch in pieces(batches, "text", 1 << 20):
            own = _Stream(utf8(column(batch, "text")))
            held.append((own.before, own.word))
            size += len(own.word)
            if size > gather:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    def build(key, table):
        parts_ = []
        for raw, n, before, word in _held(table, PAIRS):
            ids = unplanes(raw)
            parts_.append((ids, n, *shared.value.words_of(ids, before, word)))
        both, n, before, word = _joined(parts_, "QIQQ")
        del parts_
        both, at, inverse = np.unique(both, return_index=True, return_inverse=True)
        n = np.bincount(inverse, n, len(both)).astype(np.int64)
        before, word = before[at], word[at]
        hot, count2 = shared.value.find(word)
        rare, rare_count = summed(word[~hot], n[~hot])
        count2 = np.where(hot, count2, looked_up(rare, rare_count, word))
        lower = words.counts(count2) / over
        small = [(n == r).astype(np.int64) for r in range(1, K + 1)]
        context = summed(before, n, *small, lower)  # by hash, and so by part
        rows = [(key[0].as_py(), PAIRS, packed(planes(both), narrow(n)), _histogram(n)), (key[0].as_py(), COUNTS, packed(rare, rare_count), None)]
        rows += [(p, CONTEXTS, packed(planes(context[0][at]), *[c[at] for c in context[1:]]), None) for p, at in _by_part(part_of(context[0], parts))]
        return _table(rows, ("part", "kind", "data", "stats"))

    made = C.staged(docs.mapInArrow(pairs, BLOB).groupBy("part").applyInArrow(build, BLOB + ", stats array<long>"), "pairs", by="kind")
    stats = _sums(made)
    discount = Discount(stats[: K + 1])
    least = _least(stats, 1 << pair_bits - 1)
    hot_pairs = _hot(pair_bits, _collected(made, PAIRS, lambda a: [mix(unplanes(a[0])[a[1] >= least], 14), a[1][a[1] >= least]]), "Ql")

    def gathered(key, table):
        context, total, *rest = summed(*_joined([(unplanes(keys), *rest) for keys, *rest in _held(table, CONTEXTS)], "Qllllllld"))
        over_, weight = _context(discount, total, np.stack(rest[:K], axis=1), rest[K])
        return _table([(key[0].as_py(), CONTEXTS, packed(context, over_.astype(np.float64), weight), _histogram(total))], ("part", "kind", "data", "stats"))

    contexts = C.staged(made.filter(F.col("kind") == CONTEXTS).select("part", "kind", "data").groupBy("part").applyInArrow(gathered, BLOB + ", stats array<long>"), "contexts")
    C.release(made, f"kind={CONTEXTS}")
    made = spark.read.schema(made.schema).parquet(made.staged_path)  # without the files that went
    least_context = _least(_sums(contexts), 1 << word_bits - 1)
    hot_contexts = _hot(word_bits, _collected(contexts, CONTEXTS, lambda a: [x[a[1] >= least_context + 1] for x in a]), "Qdd")
    return Model(made.filter(F.col("kind") != CONTEXTS).select("part", "kind", "data"), contexts.select("part", "kind", "data"), parts, tokens, types, words, discount, unknown, float(over), hot_words, hot_pairs, hot_contexts)


def score(docs: DataFrame, model: Model, gather: int = GATHER) -> DataFrame:
    """docs (key long, text) to (key, n_tokens, n_known, base_score, score), a row for each key."""
    spark, parts = docs.sparkSession, model.parts
    table, contexts = model.table, model.contexts
    light = Model(None, None, *[getattr(model, f) for f in ("parts", "tokens", "types", "words", "pairs", "unknown", "over", "hot_words", "hot_pairs", "hot_contexts")])
    shared = spark.sparkContext.broadcast(light)
    smooth = float(model.tokens + model.types + 1)

    def base(count):
        return np.log10((count + 1) / smooth)

    def totals(key, tokens, known, low, high):
        return summed(key, tokens, known, low, high)

    def read(batches):
        m, held, size = shared.value, [], 0

        def send():
            key, before, word, ids, frequent = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(ids, kind="stable")
            key, before, word, ids = key[order], before[order], word[order], ids[order]
            part, rows = part_of(np.where(frequent[order], mix(ids, 14), word), parts), []
            for p, at in _by_part(part):
                rare = at[ids[at] >= RARE]
                docs_, which = np.unique(key[at], return_inverse=True)
                rows.append((p, EVENTS, packed(planes(ids[at]), before[rare], word[rare], docs_, which.astype(np.uint16 if len(docs_) < 1 << 16 else np.int64))))
            return next(_batched(_table(rows)))

        for batch in pieces(batches, "text", 1 << 20):
            keys, own = column(batch, "key").to_numpy(), _Stream(utf8(column(batch, "text")))
            both = m.hot_words.pair_ids(own.before, own.word)
            frequent, n2 = m.hot_words.find(own.word)
            near, n = m.hot_pairs.find(mix(both, 14))
            inside, over, weight = m.hot_contexts.find(own.before)
            done = frequent & near & inside
            high = np.zeros(len(both))
            high[done] = np.log10(m.pairs.counts(n[done].astype(np.int64)) / over[done])
            low = np.where(frequent, base(n2), 0.0)
            k = len(keys)
            rows = [np.bincount(own.doc, frequent, k).astype(np.int64), np.bincount(own.doc, low, k), np.bincount(own.doc, high, k)]
            order = np.argsort(part_of(mix(keys.astype(np.uint64), 13), parts), kind="stable")
            yield next(_batched(_table(_blobs(part_of(mix(keys.astype(np.uint64), 13), parts)[order], [keys[order], own.size[order], *[r[order] for r in rows]], SCORES))))
            rest = np.flatnonzero(~done)
            held.append((keys[own.doc[rest]], own.before[rest], own.word[rest], both[rest], frequent[rest]))
            size += len(rest)
            if size > gather:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    def passed(table, *kinds):
        return [(p, k, d) for p, k, d in zip(*(table.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True) if k in kinds]

    def evaluate(key, table):
        """Tokens at their pair's part: the pair if it is known, else the word, times the weight of the context."""
        m, rows = shared.value, passed(table, SCORES)
        seen_ = []
        for raw, before, word, docs_, which in _held(table, EVENTS):
            ids = unplanes(raw)
            seen_.append((ids, *m.hot_words.words_of(ids, before, word), docs_[which]))
        ids, before, word, doc = _joined(seen_, "QQQl")
        del seen_
        pairs, counts = _joined([(unplanes(a), c) for a, c in _held(table, PAIRS)], "QI")
        rare, rare_count = _joined(_held(table, COUNTS), "Ql")
        frequent, n2 = m.hot_words.find(word)
        n2 = np.where(frequent, n2, looked_up(rare, rare_count, word))
        n = looked_up(pairs, counts, ids).astype(np.int64)
        low = np.where(frequent, 0.0, base(n2))
        high = np.log10(np.where(n > 0, m.pairs.counts(n), m.word(n2)))
        inside, over, weight = m.hot_contexts.find(before)
        with np.errstate(divide="ignore"):
            high += np.where(inside, np.where(n > 0, -np.log10(over), np.log10(weight)), 0.0)
        ask = ~inside
        rows += _scores(doc, (~frequent & (n2 > 0)).astype(np.int64), low, high)
        if ask.any():
            order = np.argsort(before[ask], kind="stable")
            rows += _blobs(part_of(before[ask][order], parts), [doc[ask][order], before[ask][order], (n[ask] > 0)[order]], ASKS)
        return _table(rows)

    def _scores(doc, known, low, high):
        doc, known, low, high = summed(doc, known, low, high)
        way = part_of(mix(doc.astype(np.uint64), 13), parts)
        order = np.argsort(way, kind="stable")
        return _blobs(way[order], [doc[order], np.zeros(len(doc), np.int64), known[order], low[order], high[order]], SCORES) if len(doc) else []

    def backed(key, table):
        """Rare contexts at their part. One that is not in the model has no counts: the word's own probability stands."""
        rows = passed(table, SCORES)
        doc, before, seen = _joined(_held(table, ASKS), "lQ?")
        context, over, weight = _joined(_held(table, CONTEXTS), "Qdd")
        over, weight = looked_up(context, over, before), looked_up(context, weight, before)
        with np.errstate(divide="ignore"):
            high = np.where(over > 0, np.where(seen, -np.log10(over), np.log10(weight)), 0.0)
        zero = np.zeros(len(doc))
        return _table(rows + _scores(doc, zero.astype(np.int64), zero, high))

    def finish(key, table):
        doc, tokens, known, low, high = summed(*_joined(_held(table, SCORES), "llldd"))
        return pa.Table.from_arrays([pa.array(doc), pa.array(tokens), pa.array(known), pa.array(low), pa.array(high)], ["key", "n_tokens", "n_known", "base_score", "score"])

    events = C.staged(docs.select("key", "text").mapInArrow(read, BLOB).unionByName(table).groupBy("part").applyInArrow(evaluate, BLOB), "evaluated")
    asked = C.staged(events.unionByName(contexts).groupBy("part").applyInArrow(backed, BLOB), "backed")
    C.release(events)
    return asked.groupBy("part").applyInArrow(finish, "key long, n_tokens long, n_known long, base_score double, score double")


def held_out(id_: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_model_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row for each row of df: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Tokens are the words (runs of anything but ASCII white space, A to Z lower-cased) and one end; a null text has the end alone. The
    model learns from rows that are not held out; rows with a null id are learned from. base_score is that of add-one unigrams. Repeated rows
    are counted and scored each. If all rows are held out every word is unknown, and scores are 0. An empty table gives no rows.
    """
    docs = C.keyed(df, id_col, text_col)
    model = train(docs.filter(~held_out(F.col("id"))), **sizes)
    found = score(docs, model)
    rows = docs.select("key", "id").join(found, "key")
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
