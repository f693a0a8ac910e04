"""Language identification by a linear-chain conditional random field over words.

Each word has a label, its language. Emissions are sums of weights of the word's byte n-grams with its ends marked (so of prefixes and
suffixes up to four bytes too), of a lexicon feature (the language in whose training words it is seen, and whether in that one alone) and of a
bias; transitions and start weights are learned with them by gradient ascent on the exact likelihood. Training sequences join segments
of documents of different languages, so the transitions know code-switched text. A text's languages are the mean posterior marginals of
its words, by forward-backward over the whole text.

The field is fitted on the driver on a bounded sample of labelled rows (PER_LANG documents of a language, SEGMENTS segments of SPAN words
of each); prediction is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .arrow import column, pieces

#: Bounds of the training sample: documents of a language (in expectation), segments of a document, words in a segment.
PER_LANG, SEGMENTS, SPAN = 500, 4, 25
#: Words in a training sequence; weights of hashed n-grams; words cached by a worker.
SEQUENCE, WEIGHTS, CACHE = 100, 1 << 17, 200_000
ORDERS = (2, 3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if any(map(str.isalpha, w))]


def features(types: list[str], weights: int = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features of the words, in one array, and where each word's begin."""
    raw = np.frombuffer(b"".join(b"^" + w.encode("utf-8", "replace") + b"$" for w in types), np.uint8).astype(np.uint64)
    size = np.array([len(w.encode("utf-8", "replace")) + 2 for w in types], np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(types)), size)
    room = np.repeat(start + size, size) - np.arange(len(raw))
    ids, owners, rolled = [], [], np.zeros(len(raw), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        later = np.zeros(len(raw), np.uint64)
        later[: len(raw) - n + 1] = raw[n - 1 :]
        rolled = rolled * np.uint64(1_000_003) + later + np.uint64(1)
        if n in ORDERS:
            at = np.flatnonzero(room >= n)
            mixed = (rolled[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            ids.append((mixed >> np.uint64(40)).astype(np.int64) % weights)
            owners.append(owner[at])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(types))
    return ids[order], np.cumsum(counts) - counts


class Field:
    """A fitted field; labels are the learned languages in order."""

    def __init__(self, labels: list[str], weights: int = WEIGHTS):
        k = len(labels)
        self.labels, self.lexicon = labels, {}
        self.w = np.zeros((weights, k))
        self.lex = np.zeros((2 * k + 1, k))
        self.bias, self.start, self.move = np.zeros(k), np.zeros(k), np.zeros((k, k))

    def emissions(self, types: list[str]) -> np.ndarray:
        if not types:
            return np.empty((0, len(self.labels)))
        ids, begin = features(types, len(self.w))
        lex = np.array([self.lexicon.get(w, 0) for w in types])
        return np.add.reduceat(self.w[ids], begin, axis=0) + self.lex[lex] + self.bias

    def learn_lexicon(self, seen: list[tuple[str, int]]) -> None:
        counts: dict[str, Counter] = {}
        for w, y in seen:
            counts.setdefault(w, Counter())[y] += 1
        for w, c in counts.items():
            if (total := sum(c.values())) > 1:
                y, n = c.most_common(1)[0]
                self.lexicon[w] = 1 + 2 * y + (n == total)

    def marginals(self, emissions: np.ndarray, begins: np.ndarray, steps: int = 64) -> np.ndarray:
        """Posterior of each word's label. The words of several texts stand one after another; begins: where each text does.

        Forward-backward in blocks: products of transfer matrices give what enters each block, then all blocks go on side by side."""
        n, k = emissions.shape
        if not n:
            return np.empty((0, k))
        blocks = -(-n // steps)
        e = np.ones((blocks * steps, k))
        e[:n] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        new = np.zeros(blocks * steps, bool)
        new[begins], new[n:] = True, True
        e, new = e.reshape(blocks, steps, k), new.reshape(blocks, steps)
        move, start = np.exp(self.move - self.move.max()), np.exp(self.start - self.start.max())
        product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for t in range(steps):
            moved = (product.reshape(-1, k) @ move).reshape(blocks, k, k)
            if new[:, t].any():
                moved[new[:, t]] = product[new[:, t]].sum(axis=2, keepdims=True) * start
            product = moved * e[:, None, t]
            product /= product.max(axis=(1, 2), keepdims=True)
        enter, leave = np.ones((blocks, k)), np.ones((blocks, k))
        for c in range(1, blocks):
            v = enter[c - 1] @ product[c - 1]
            enter[c] = v / v.sum()
        for c in range(blocks - 1, 0, -1):
            v = product[c] @ leave[c]
            leave[c - 1] = v / v.sum()
        alpha, out, beta = enter / enter.sum(axis=1, keepdims=True), np.empty((blocks, steps, k)), leave
        for t in range(steps):
            moved = alpha @ move
            moved[new[:, t]] = start
            alpha = moved * e[:, t]
            alpha /= alpha.sum(axis=1, keepdims=True)
            out[:, t] = alpha
        for t in range(steps - 1, -1, -1):
            out[:, t] *= beta
            v = e[:, t] * beta
            beta = v @ move.T
            beta[new[:, t]] = 1.0
            beta /= beta.sum(axis=1, keepdims=True)
        out = out.reshape(-1, k)[:n]
        return out / out.sum(axis=1, keepdims=True)


def fit(segments: list[tuple[str, list[str]]], rounds: int = 40, seed: int = 5) -> Field:
    """segments: (language, words). Joined at random into sequences of SEQUENCE words and learned by Adam on the penalised likelihood."""
    labels = sorted({y for y, w in segments if w})
    field = Field(labels)
    if not labels:
        return field
    rng, k = np.random.default_rng(seed), len(labels)
    order = rng.permutation(len(segments))
    flat = [(w, labels.index(segments[i][0])) for i in order for w in segments[i][1]]
    field.learn_lexicon(flat)
    types = {w: i for i, w in enumerate(dict.fromkeys(w for w, _ in flat))}
    ids, begin = features(list(types), len(field.w))
    owner = np.repeat(np.arange(len(types)), np.diff(np.append(begin, len(ids))))
    lex = np.array([field.lexicon.get(w, 0) for w in types])
    word, y = np.array([types[w] for w, _ in flat]), np.array([v for _, v in flat])
    begins = np.arange(0, len(word), SEQUENCE)
    inner = np.ones(len(word), bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    truth = np.eye(k)[y]
    moved = np.zeros((k, k))
    np.add.at(moved, (y[at - 1], y[at]), 1)
    params = [field.w, field.lex, field.bias, field.start, field.move]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        scores = np.add.reduceat(field.w[ids], begin, axis=0) + field.lex[lex] + field.bias
        e = scores[word]
        p = field.marginals(e, begins)
        # Posterior of two neighbours, from the marginals of the left one and the chain's own factors.
        pair = _pairs(field, e, begins, at)
        gap = truth - p
        by_type = np.stack([np.bincount(word, gap[:, j], len(types)) for j in range(k)], axis=1)
        grads = [
            np.stack([np.bincount(ids, by_type[owner, j], len(field.w)) for j in range(k)], axis=1) / len(word) - 1e-6 * field.w,
            np.stack([np.bincount(lex, by_type[:, j], len(field.lex)) for j in range(k)], axis=1) / len(word) - 1e-6 * field.lex,
            gap.sum(axis=0) / len(word), gap[begins].sum(axis=0) / len(word), (moved - pair) / len(word) - 1e-6 * field.move,
        ]
        for v, g, m, s in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            v += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-8)
    return field


def _pairs(field: Field, e: np.ndarray, begins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected transitions over training sequences, which are SEQUENCE long but for the last."""
    k, n = len(field.labels), len(begins)
    wide = np.zeros((n * SEQUENCE, k))
    wide[: len(e)] = np.exp(e - e.max(axis=1, keepdims=True))
    live = np.zeros(n * SEQUENCE, bool)
    live[: len(e)] = True
    wide, live = wide.reshape(n, SEQUENCE, k), live.reshape(n, SEQUENCE)
    move, start = np.exp(field.move - field.move.max()), np.exp(field.start - field.start.max())
    alpha, beta = np.empty((SEQUENCE, n, k)), np.ones((SEQUENCE, n, k))
    a = start * wide[:, 0]
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, SEQUENCE):
        a = np.where(live[:, t, None], (alpha[t - 1] @ move) * wide[:, t], 1.0)
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    for t in range(SEQUENCE - 2, -1, -1):
        b = np.where(live[:, t + 1, None], (wide[:, t + 1] * beta[t + 1]) @ move.T, 1.0)
        beta[t] = b / b.sum(axis=1, keepdims=True)
    out = np.zeros((k, k))
    for t in range(1, SEQUENCE):
        both = (alpha[t - 1][:, :, None] * move * (wide[:, t] * beta[t])[:, None, :])[live[:, t]]
        out += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return out


def sample(rows: DataFrame, per_lang: int = PER_LANG, segments: int = SEGMENTS, span: int = SPAN) -> list[tuple[str, list[str]]]:
    """Labelled segments of rows (id, text, lang): of each language a sample by the id's hash, of each document segments at hashed places."""
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    share = {r["lang"]: min(1.0, per_lang / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return []
    rate = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])[F.col("lang")]
    mixed = F.xxhash64(F.col("id").cast("string"))
    drawn = rows.filter(F.pmod(mixed, F.lit(1 << 20)) < rate * (1 << 20)).select("lang", "text", F.pmod(F.shiftright(mixed, 20), F.lit(1 << 30)).alias("place"))

    def cut(batches):
        for batch in pieces(batches, "text", 1 << 20):
            langs, out = [], []
            for lang, text, place in zip(*(column(batch, c).to_pylist() for c in ("lang", "text", "place")), strict=True):
                own = words(text)
                for j in range(min(segments, -(-len(own) // span)) if own else 0):
                    at = (place + j * 7919 * span) % max(1, len(own) - span + 1)
                    langs.append(lang)
                    out.append(" ".join(own[at : at + span]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], ["lang", "words"])

    got = drawn.mapInArrow(cut, "lang string, words string").toArrow()  # bounded: PER_LANG * SEGMENTS * SPAN words of a language
    return sorted((a, b.split(" ")) for a, b in zip(got.column("lang").to_pylist(), got.column("words").to_pylist(), strict=True))


def predict(rows: DataFrame, field: Field, inside: str | None = None) -> DataFrame:
    """rows (with a string column text, which goes) and lang_pred, score. With inside the text is that field of the struct column row, and stays there:
    so a text that is kept goes to the worker once."""
    shared = rows.sparkSession.sparkContext.broadcast(field)
    kept = [f for f in rows.schema if inside or f.name != "text"]
    at = rows.schema["row"].dataType.fieldNames().index(inside) if inside else None
    texts = (lambda batch: column(batch, "text")) if at is None else (lambda batch: column(batch, "row").field(at))
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches):
        own = shared.value
        known: dict[str, int] = {}
        table = np.empty((0, len(own.labels)))
        for batch in pieces(batches, texts, 1 << 18):
            found = [words(t) if t else [] for t in texts(batch).to_pylist()]
            size = np.array([len(w) for w in found], np.int64)
            every = [w for f in found for w in f]
            fresh = set(every).difference(known)
            if len(known) + len(fresh) > CACHE:
                known, table, fresh = {}, np.empty((0, len(own.labels))), set(every)
            if fresh and own.labels:
                fresh = list(fresh)
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                table = np.concatenate([table, own.emissions(fresh)])
            pred, score = np.full(len(found), -1), np.zeros(len(found))
            full = np.flatnonzero(size) if own.labels else np.empty(0, np.int64)
            if len(full):
                begins = np.cumsum(size[full]) - size[full]
                ids = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
                means = np.add.reduceat(own.marginals(table[ids], begins), begins, axis=0) / size[full, None]
                pred[full], score[full] = means.argmax(axis=1), np.minimum(means.max(axis=1), 1.0)
            names = pa.array([own.labels[p] if p >= 0 else "und" for p in pred.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[column(batch, f.name) for f in kept], names, pa.array(score)], schema.names)

    return rows.mapInArrow(label, schema)


def held_out(id_: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    rows = df.select(C.col(id_col).alias("id"), C.col(text_col).cast("string").alias("text"), C.col(lang_col).cast("string").alias("lang"))
    return fit(sample(rows.filter(~held_out(F.col("id")))))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", field: Field | None = None) -> DataFrame:
    """One row for each row of df: id_col, held_out, lang_pred, score (the mean posterior of that language over the words, 0 to 1).

    lang_pred is und with score 0 for a null text, one without a letter, or where nothing could be learned. Rows with a null id are neither
    held out nor learned from. Only text is an input of a prediction. Repeated rows get equal results; an empty table gives no rows.
    """
    field = field or fitted(df, id_col, text_col, lang_col)
    rows = df.select(C.col(id_col).alias("id"), C.col(text_col).cast("string").alias("text"))
    return predict(rows, field).select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0, field: Field | None = None) -> DataFrame:
    """The rows of df, all columns, that have a language with at least this score; und goes, and so do null texts.

    Rows with a null id are judged like others, repeated rows are judged alike and all stay or go, and an empty table gives no rows."""
    field = field or fitted(df, id_col, text_col, lang_col)
    rows = C.packed(df, id_col, text_col)
    if isinstance(rows.schema["text"].dataType, T.StringType):
        found = predict(rows.select("row"), field, text_col)
    else:
        found = predict(rows.select("row", F.col("text").cast("string").alias("text")), field)
    return found.filter(F.col("lang_pred") != "und").filter(F.col("score") >= least).select("row.*")
