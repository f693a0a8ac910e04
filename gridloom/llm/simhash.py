"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints within three bits of each other agree on one of four 16-bit blocks, so each is dealt to its four (mask, value)
groups; a group that is too large is dealt again by quarters of its free bits, which again loses no pair. Within a group the fingerprints
stand in Gray rank order, where neighbours share most bits. Runs of them are leaves; leaves and nodes hold only the bits that are common
below them and not already in the node above (mask and pattern), so the differences of two nodes add up level by level, and a pair of
nodes that differ in more than three bits is dropped with everything below. Node pairs that are one component already, or that can only
be within three bits, are settled whole: no group emits its pairs, only one edge for each fingerprint that joins a component.

Components of the edges come from a distributed contraction; documents get them through their fingerprints.

For near copies by a similarity of word shingles (keep_similar) the same index is a filter: several fingerprints of each document, each from hashes mixed
anew, are dealt once to each of their four blocks, so a document has the same number of rows in a corpus of any size. Within a group of one block's value the index finds
fingerprints with a neighbour within a wider radius, and documents with such a one are compared by their shingles; an exact join finds the links that this misses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .arrow import column, lists, pieces, ranges, utf8
from .components import components
from .jaccard import linked
from .windows import mix

SEED = 42
#: For similar documents: words in a shingle, similarity, fingerprints of a document, and differing bits within which two are candidates.
WORDS, SIMILARITY, FINGERPRINTS, RADIUS = 5, 0.8, 6, 9
#: Fingerprints in a group before it is dealt again by more bits.
GROUP = 10_000
LEAF = FAN = 8


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Each text's 64-bit SimHash of its word shingles' XXH64; 0 without words."""
    return majority(*shingle_hashes(texts, shingle))


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' shingles' XXH64, and how many each text has."""
    hashed, counts = [], []
    for text in texts:
        words = text.lower().split()
        if len(words) <= shingle:
            own = [b" ".join(words)] if words else []
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
            own = [joined[s:e] for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        hashed += [xxhash.xxh64_intdigest(x, SEED) for x in own]
        counts.append(len(own))
    return np.array(hashed, np.uint64), np.array(counts, np.int64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ends = np.cumsum(counts[full])
        total = np.add.reduceat(bits, ends - counts[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * total > counts[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray code sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _labels(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i] in parent, which always names each one's smallest member."""
    while len(a):
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


class GrayIndex:
    """The hierarchy over fingerprints sorted by (group, Gray rank); a node never spans two groups."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp, self.parent = fp, np.arange(len(fp))
        self.levels = []  # from the leaves up: begin and end in the level below, first and last fingerprint, mask, pattern
        begin, own = np.arange(len(fp)), group
        ones, zeros = fp, ~fp  # bits that all below have set, or unset
        lo, hi = begin, begin + 1
        for fan in (LEAF, *[FAN] * 40):
            place = np.arange(len(own)) - np.searchsorted(own, own)
            cut = np.flatnonzero(place % fan == 0)
            ends = np.append(cut[1:], len(own))
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            lo, hi, own = lo[cut], hi[ends - 1], own[cut]
            self.levels.append({"begin": cut, "end": ends, "lo": lo, "hi": hi, "mask": ones | zeros, "pattern": ones})
            if len(np.unique(own)) == len(own):
                break
        for above, below in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):  # what the node above holds is factored out
            up = np.repeat(np.arange(len(above["begin"])), above["end"] - above["begin"])
            below["own"] = below["mask"] & ~above["mask"][up]
        self.levels[-1]["own"] = self.levels[-1]["mask"]

    def _settled(self, a: np.ndarray, b: np.ndarray, level: dict) -> np.ndarray:
        """Pairs of nodes whose fingerprints are all in one component."""
        low, high = level["low"], level["high"]
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])

    def _refresh(self) -> None:
        low = high = self.parent
        for level in self.levels:
            level["low"], level["high"] = np.minimum.reduceat(low, level["begin"]), np.maximum.reduceat(high, level["begin"])
            low, high = level["low"], level["high"]

    def link(self, most: int, chunk: int = 60_000) -> np.ndarray:
        """Each fingerprint's smallest component member, over pairs within `most` bits of one group."""
        roots = np.arange(len(self.levels[-1]["begin"]))
        leaves = np.arange(len(self.levels[0]["begin"]))
        self._pairs(leaves, leaves, most)  # neighbours in Gray order first: whole nodes become one component
        self._refresh()
        work = [(len(self.levels) - 1, roots, roots, np.zeros(len(roots), np.int64))]
        while work:
            at, a, b, differ = work.pop()
            if len(a) > chunk:
                work += [(at, a[i : i + chunk], b[i : i + chunk], differ[i : i + chunk]) for i in range(0, len(a), chunk)][::-1]
                continue
            level = self.levels[at]
            keep = ~self._settled(a, b, level)
            a, b, differ = a[keep], b[keep], differ[keep]
            # Bits common in both nodes but in one only factored out above are compared here; none is counted twice.
            both = level["mask"][a] & level["mask"][b]
            differ = np.bitwise_count((level["pattern"][a] ^ level["pattern"][b]) & both).astype(np.int64) if at == len(self.levels) - 1 else differ + np.bitwise_count((level["pattern"][a] ^ level["pattern"][b]) & both & (level["own"][a] | level["own"][b])).astype(np.int64)
            keep = differ <= most
            a, b, differ, both = a[keep], b[keep], differ[keep], both[keep]
            sure = differ + 64 - np.bitwise_count(both) <= most  # whatever the free bits are
            for x, y in ((a[sure], a[sure]), (b[sure], b[sure]), (a[sure], b[sure])):
                n = level["hi"][y] - level["lo"][y]
                _labels(self.parent, np.repeat(level["lo"][x], n), ranges(level["lo"][y], n))
            a, b, differ = a[~sure], b[~sure], differ[~sure]
            if not at:
                self._pairs(a, b, most)
            elif len(a):
                na, nb = level["end"][a] - level["begin"][a], level["end"][b] - level["begin"][b]
                for i in range(0, len(a), max(1, chunk // FAN)):
                    s = slice(i, i + max(1, chunk // FAN))
                    x, y, d = np.repeat(level["begin"][a[s]], na[s] * nb[s]), level["begin"][b[s]], np.repeat(differ[s], na[s] * nb[s])
                    nth = ranges(np.zeros(len(y), np.int64), na[s] * nb[s])
                    wide = np.repeat(nb[s], na[s] * nb[s])
                    x, y = x + nth // wide, np.repeat(y, na[s] * nb[s]) + nth % wide
                    ordered = x <= y
                    work.append((at - 1, x[ordered], y[ordered], d[ordered]))
            self._refresh()
        return self.parent

    def _pairs(self, a: np.ndarray, b: np.ndarray, most: int) -> None:
        """Compare the fingerprints of leaf a[i] with those of leaf b[i]."""
        leaf = self.levels[0]
        for i in range(0, len(a), 5_000):
            x, y = a[i : i + 5_000], b[i : i + 5_000]
            na, nb = leaf["end"][x] - leaf["begin"][x], leaf["end"][y] - leaf["begin"][y]
            nth, wide = ranges(np.zeros(len(x), np.int64), na * nb), np.repeat(nb, na * nb)
            p, q = np.repeat(leaf["begin"][x], na * nb) + nth // wide, np.repeat(leaf["begin"][y], na * nb) + nth % wide
            near = (p < q) & (np.bitwise_count(self.fp[p] ^ self.fp[q]) <= most)
            _labels(self.parent, p[near], q[near])


def _quarters(mask: int) -> list[int]:
    """Masks that hold mask and a quarter of the bits outside it."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // 4 for i in range(5)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def edges_within(nodes: DataFrame, most: int = 3, group: int = GROUP) -> DataFrame:
    """nodes: distinct fingerprints, a long column fp. Edges (a, b) that join the same fingerprints into components as all pairs within
    `most` (0 to 3) bits do."""
    if not 0 <= most <= 3:
        raise ValueError("four blocks find pairs within three bits")
    masks, parts = _quarters(0), []
    rows = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        large = C.staged(rows.groupBy("mask", "value").count().filter(F.col("count") > group).select("mask", "value"), "large")
        many = large.count()
        if not many or bin(masks[0]).count("1") >= 60:
            parts.append(rows)
            break
        large = F.broadcast(large) if many * 64 <= C.BROADCAST_BYTES else large
        parts.append(rows.join(large, ["mask", "value"], "left_anti"))
        below = {m: _quarters(m) for m in masks}
        masks = sorted({x for v in below.values() for x in v})
        deal = F.create_map(*[x for m, v in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in v]))])
        rows = rows.join(large, ["mask", "value"], "left_semi").select("fp", F.explode(deal[F.col("mask")]).alias("mask"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(spread, "mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(_linker(most), "a long, b long")


def _linker(most: int, names: tuple[str, ...] = ("mask", "value"), members: bool = False, chunk: int = 200_000):
    """Over rows sorted by these columns, which name a group, and fp: edges (a, b), or the members (first column, fp) of components of two and more."""
    keys = len(names)

    def link(batches):
        held: list[np.ndarray] = []
        size = 0

        def done(rows: np.ndarray):
            group = np.concatenate([[0], np.cumsum((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1))])
            full = np.bincount(group)[group] > 1
            group, fp, first = group[full], rows[full, keys].astype(np.int64).view(np.uint64), rows[full, 0]
            if len(fp):
                order = np.lexsort((gray_rank(fp), group))
                fp, group, first = fp[order], group[order], first[order]
                parent = GrayIndex(fp, group).link(most)
                if members:
                    own = np.flatnonzero(np.bincount(parent)[parent] > 1)
                    yield pa.RecordBatch.from_arrays([pa.array(first[own]), pa.array(fp[own].view(np.int64))], [names[0], "fp"])
                else:
                    own = np.flatnonzero(parent != np.arange(len(fp)))
                    yield pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[parent[own]].view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(np.stack([column(batch, c).to_numpy() for c in (*names, "fp")], axis=1))
            size += len(held[-1])
            if size >= chunk:  # the last group may go on
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, :keys] != rows[-1, :keys]).any(axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from done(rows[:cut])
                held = [rows[cut:]]
                size = len(held[0])
        if size:
            yield from done(np.concatenate(held))

    return link


def printed(rows: DataFrame, shingle: int = WORDS, prints: int = FINGERPRINTS) -> DataFrame:
    """rows (key long, text): key and prints, so many fingerprints of the text, each from its shingles' hashes mixed anew."""

    def sign(batches):
        for batch in pieces(batches, "text", 1 << 18):
            h, counts = shingle_hashes(utf8(column(batch, "text")), shingle)
            made = np.stack([majority(mix(h, i * SEED) if i else h, counts).view(np.int64) for i in range(prints)], axis=1)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), lists(made.ravel(), np.full(len(counts), prints), pa.int64())], ["key", "prints"])

    from pyspark.sql import types as T

    return rows.select("key", "text").mapInArrow(sign, T.StructType([T.StructField("key", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType()))]))


def neighboured(made: DataFrame, most: int = RADIUS) -> DataFrame:
    """Of printed rows those one of whose fingerprints has another row's same fingerprint within `most` bits that agrees with it on one of its four blocks of 16 bits (always
    so up to three bits). Each distinct fingerprint makes four rows, of two numbers each: its number, the block's and its value in one, and itself."""
    each = made.select("key", F.posexplode("prints").alias("nth", "fp"))
    nodes = C.staged(each.groupBy("nth", "fp").agg(F.count(F.lit(1)).alias("n")), "nodes")
    block = lambda b: F.shiftrightunsigned("fp", 16 * b).bitwiseAND(F.lit(0xFFFF))
    groups = [(F.col("nth") * 4 + b) * F.lit(1 << 16) + block(b) for b in range(4)]
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select(F.explode(F.array(*groups)).alias("group"), "fp").repartition(parts, "group").sortWithinPartitions("group")
    found = dealt.mapInArrow(_linker(most, ("group",), members=True), "group long, fp long").select(F.shiftright("group", 18).cast("int").alias("nth"), "fp")
    near = found.unionByName(nodes.filter("n > 1").select("nth", "fp"))
    keys = each.join(C.staged(near.distinct(), "near").hint("merge"), ["nth", "fp"]).select("key").distinct()
    return made.join(keys, "key", "left_semi")


def keep_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY, most: int = RADIUS, prints: int = FINGERPRINTS) -> DataFrame:
    """The rows of df, with all their columns, that stay: of each group of near copies the one with the smallest id (null ids last; of rows that
    share it one, by their texts' hash).

    Pairs with this similarity of their shingles are links, and chains of links are a group. Rows with a fingerprint within `most` bits of another's are compared first,
    by all their shingles; then the exact join (see jaccard.linked) looks for the links between groups and rows that this did not join, so none is missed and a group's own
    pairs are not compared again. A null text counts as empty, and texts without words are copies. An empty table gives no rows.
    """
    rows = C.keyed(df, id_col, text_col, rows=True)
    made = C.staged(printed(rows, shingle, prints), "fingerprints")
    near = C.staged(neighboured(made, most), "neighboured")
    C.release(made)
    own = near.select("key")
    own = F.broadcast(own) if near.count() * 24 <= C.BROADCAST_BYTES else own
    compared = C.staged(rows.select("key", "text").join(own, "key", "left_semi"), "compared")
    found = linked(compared, shingle, similarity, whole=False)
    C.release(compared)
    found = linked(rows, shingle, similarity, known=found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b"))
    gone = C.staged(found.filter("node != root").select(F.col("node").alias("key")), "gone")
    gone = F.broadcast(gone) if gone.count() * 24 <= C.BROADCAST_BYTES else gone
    return rows.join(gone, "key", "left_anti").select("row.*")


def near_duplicates(rows: DataFrame, shingle: int = 3, most: int = 3, group: int = GROUP) -> DataFrame:
    """rows (id, text) as (id, fingerprint long, component_id): component_id is the smallest id that is reachable over links of at most
    `most` differing bits. Null and empty texts have fingerprint 0, which links as any other. Null ids are never the smallest."""

    def sign(batches):
        for batch in pieces(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(fingerprints(utf8(column(batch, "text")), shingle).view(np.int64))], ["id", "fp"])

    from pyspark.sql import types as T

    made = C.staged(rows.select("id", "text").mapInArrow(sign, T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())])), "fingerprints")
    nodes = C.staged(made.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    found = components(edges_within(nodes, most, group))
    found = C.staged(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left"), "joined")
    firsts = C.staged(found.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    known = found.join(firsts, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    known = C.staged(known, "known")
    return made.join(known.hint("merge"), "fp").select("id", F.col("fp").alias("fingerprint"), "component_id")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """One row for each row of df: id_col, fingerprint (16 hex digits), component_id (see near_duplicates).

    A to Z are lower-cased; words are runs of anything but ASCII white space; fewer words than a shingle are one shingle. Repeated rows share
    a component; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = df.select(C.col(id_col).alias("id"), C.col(text_col).cast("string").alias("text"))
    found = near_duplicates(rows, shingle, most)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """The rows of df, with all their columns, that stay: of each group of simhash_groups the one with the smallest id (null ids last; of
    rows that share it one, by their texts' hash). The ids of the others meet the rows, which move only if those ids are too many to broadcast."""
    rows = C.keyed(df, id_col, text_col, rows=True)
    found = near_duplicates(rows.select(F.col("key").alias("id"), "text"), shingle, most)
    gone = C.staged(found.filter("id != component_id").select(F.col("id").alias("key")), "gone")
    gone = F.broadcast(gone) if gone.count() * 24 <= C.BROADCAST_BYTES else gone
    return rows.join(gone, "key", "left_anti").select("row.*")
