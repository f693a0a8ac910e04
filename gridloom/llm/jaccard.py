"""Near copies by the exact Jaccard similarity of their word shingles, through a prefix-filtered self-join.

Two sets with a similarity of s or more share one of the n - ceil(s n) + 1 first shingles of each, in any one order over all documents. Candidates
of fitting sizes are compared by their whole sets (of 64-bit hashes), so no pair is lost and none below s is linked.
similar_pairs gives all pairs, with the rarest shingles first; linked gives their components, with work that does not grow with the pairs inside one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prefix import ranged
from . import common as C
from .arrow import column, lists, pieces, utf8
from .components import components
from .windows import mix

SHINGLE, SIMILARITY = 5, 0.8
#: Against rounding in products with the similarity.
SLACK = 1e-9


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of the text's word shingles, made from its words' XXH64, in unsigned order; fewer words than a shingle are one, no words too."""
    words = text.lower().split()
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    wide = min(shingle, len(words))
    n = len(words) - wide + 1
    h = np.full(n, wide, np.uint64)
    for i in range(wide):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n])
    return np.unique(h).view(np.int64)


def similar_pairs(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """rows (key long, text): (a, b) with a < b, every pair whose shingles have at least this similarity."""

    def hashed(batches):
        for batch in pieces(batches, "text", 1 << 20):
            own = [shingles(t, shingle) for t in utf8(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), lists(np.concatenate(own), [len(x) for x in own], pa.int64())], ["key", "own"])

    kind = T.StructType([T.StructField("key", T.LongType()), T.StructField("own", T.ArrayType(T.LongType()))])
    sets = C.staged(rows.select("key", "text").mapInArrow(hashed, kind), "sets")
    prefix = _prefixes(sets, similarity)
    a, b = (prefix.select("h", F.col("key").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    near = C.staged(a.join(b.hint("merge"), "h").filter((F.col("a") < F.col("b")) & _fits(similarity)).select("a", "b").distinct(), "candidates")
    return _verified(near, sets, similarity)


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """sets (key, own) to (key, n, h): the rarest shingles of each set, one of which every similar set shares."""
    each = sets.select("key", F.size("own").alias("n"), F.explode("own").alias("h"))
    shared = C.staged(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    least = F.ceil(F.lit(similarity) * F.col("n") - SLACK)
    rarest = each.join(shared.hint("merge"), "h").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("found"))
    room = (F.size("found") - least + 1).cast("int")  # the prefix without the n - size(found) shingles of this document alone
    return C.staged(rarest.filter(room > 0).select("key", "n", F.explode(F.slice("found", F.lit(1), room)["h"]).alias("h")), "prefix")


def _fits(similarity: float):
    return F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - SLACK


def _verified(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets have this similarity."""
    named = C.staged(near.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "named")
    sets = sets.join(_small(named), "key", "left_semi")  # no other set moves
    one, two = (sets.select(F.col("key").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    both = near.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    common = F.size(F.array_intersect("own_a", "own_b"))
    return both.filter(common >= F.lit(similarity) * (F.size("own_a") + F.size("own_b") - common) - SLACK).select("a", "b")


def _small(keys: DataFrame) -> DataFrame:
    """A staged table of keys, broadcast if it fits."""
    return F.broadcast(keys) if keys.count() * 24 <= C.BROADCAST_BYTES else keys


def linked(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, known: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """rows (key long, text): (node, root) as the components of all similar pairs, without the pairs inside a component.

    Equal sets (by SHA-256) are one. The order of the prefixes is that of the hashes, but for the most frequent shingles, which come last; so a prefix needs no count over
    all shingles, and only prefixes shuffle. First each set is compared with its neighbour by size and with the smallest key in the list of each of its shingles: mostly that
    joins a group of near copies. Then the pairs of each list that are not in one component yet are compared, all of them; lists of one component have none. Pairs
    must have enough shingles in common in their prefixes, and marks (see _signer) that are near enough, before whole sets move, which loses no similar pair.

    known (a, b): pairs that are one component already. Without whole the second step is left out: every link is right, but some may be missing.

    Each table goes as soon as the next one is written, and the rows of lists have no marks: those meet the pairs, and in the second step the lists that still have pairs.
    """
    rows = rows.select("key", "text")
    every = C.staged(rows.mapInArrow(_signer(shingle, similarity, None), _SIGNED), "signed")
    firsts = C.staged(every.groupBy("digest").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "b"), "equal")
    copies = C.staged(every.select("digest", F.col("key").alias("a")).join(firsts.hint("merge"), "digest").filter("a != b").select("a", "b"), "copies")
    single = every.join(_small(copies.select(F.col("a").alias("key"))), "key", "left_anti")
    marks = C.staged(single.filter(F.size("marks") > 0).select("key", "n", "marks"), "marks")
    prefix = C.staged(_unlike_last(single, rows, shingle, similarity), "prefix")
    _drop(every, firsts)
    lists = _lists(prefix)
    settled = copies.unionByName(known.select("a", "b")) if known else copies

    firsts = C.staged(lists.groupBy("h").agg(F.min(F.struct("key", "n")).alias("x")), "firsts")
    order = ranged(lists.select("h", "n", "key"), ["h", "n", "key"])
    both = _after(order).unionByName(lists.join(firsts.hint("merge"), "h").select("key", "n", "x")).filter("x.key != key")
    both = both.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("x.key").alias("b"), F.col("x.n").alias("n_b"))
    both = both.filter(_fits(similarity)).select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"), _share(similarity).alias("share"))
    met = C.staged(_sharing(both), "met")  # a pair may meet in fewer lists here than it has in common, so some wait for the second step
    _drop(firsts, order)
    tried = C.staged(_marked(met, marks, similarity), "candidates")
    if known:
        tried = C.staged(_apart(tried, components(settled)), "apart")
    sets = _sets(tried, rows, shingle)
    settled = C.staged(_verified(tried, sets, similarity).unionByName(settled), "links")
    _drop(met, sets)
    found = components(settled)
    if not whole:
        _drop(lists, marks)
        return found
    own = _mixed(lists, found, marks)
    rest = C.staged(_across(own, similarity).join(tried, ["a", "b"], "left_anti"), "rest")
    _drop(own)
    sets = _sets(rest, rows, shingle)
    more = C.staged(_verified(rest, sets, similarity), "more")
    _drop(sets)
    return components(more.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b")))


def _drop(*tables: DataFrame) -> None:
    for table in tables:
        C.release(table)


#: A prefix has one more shingle for so many that a similar set must share, and similar sets share as many more in their prefixes.
EACH = 40
#: Bits of the marks of a set; documents of a list beyond which its shingle is frequent, and the most of such shingles, which go to all tasks.
MARKS, FREQUENT, MOST = 512, 100, 100_000
_SIGNED = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])


def _signer(shingle: int, similarity: float, last: np.ndarray | None):
    """Over rows (key, text): n shingles, their digest, marks and prefix, in the order of the hashes but with those of last (sorted) at its end.

    A shingle flips one bit of the marks, so two sets have at least as many shingles apart as their marks have bits. Sets so large that similar ones may be apart by half the
    bits, which is what any two large sets have, get none."""
    most = MARKS / 4 * (1 + similarity) / (1 - similarity) if similarity < 1 else np.inf

    def signed(batches):
        for batch in pieces(batches, "text", 1 << 19):
            own = [shingles(t, shingle) for t in utf8(column(batch, "text"))]
            n = np.array([len(x) for x in own])
            h = np.concatenate(own)
            at = np.repeat(np.arange(len(own)), n) * MARKS + (mix(h.view(np.uint64)) % np.uint64(MARKS)).astype(np.int64)
            flips = (np.bincount(at, minlength=len(own) * MARKS) & 1).astype(np.uint8)
            few = n <= most
            marks = np.packbits(flips, bitorder="little").view("<i8").reshape(len(own), -1)[few]
            if last is not None:
                own = [x[np.argsort(np.isin(x, last, assume_unique=True), kind="stable")] for x in own]
            least = np.ceil(similarity * n - SLACK).astype(np.int64)
            size = n - least + 1 + least // EACH
            prefix = np.concatenate([x[:m] for x, m in zip(own, size, strict=True)])
            digests = pa.array([hashlib.sha256(np.sort(x).tobytes()).digest() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(n, pa.int32()), digests, lists(marks.ravel(), few * (MARKS // 64), pa.int64()), lists(prefix, size, pa.int64())], _SIGNED.names)

    return signed


def _unlike_last(single: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(key, n, h): the prefixes of single. Where one holds a frequent shingle it is made again with those at the end of the order; all others stay as they are."""
    each = single.select("key", "n", F.explode("prefix").alias("h"))
    frequent = each.groupBy("h").count().filter(F.col("count") > FREQUENT).orderBy(F.desc("count"), "h").limit(MOST)
    last = np.sort(np.array([r.h for r in frequent.select("h").collect()], np.int64))
    if not len(last):
        return each
    table = single.sparkSession.createDataFrame([(int(h),) for h in last], "h long")
    named = C.staged(each.join(F.broadcast(table), "h", "left_semi").select("key").distinct(), "frequent")
    again = rows.join(_small(named), "key", "left_semi").mapInArrow(_signer(shingle, similarity, last), _SIGNED)
    return each.join(_small(named), "key", "left_anti").unionByName(again.select("key", "n", F.explode("prefix").alias("h")))


def _lists(prefix: DataFrame) -> DataFrame:
    """(h, key, n): the lists of two and more documents. The table prefix goes."""
    shared = C.staged(prefix.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("h"), "shared")
    lists = C.staged(prefix.join(shared.hint("merge"), "h"), "lists")
    _drop(prefix, shared)
    return lists


def _near(similarity: float) -> Column:
    """Whether marks_a and marks_b leave room for this similarity: of n_a + n_b shingles so many may be apart. Without the marks of both they do."""
    bits = sum((F.bit_count(F.col("marks_a")[i].bitwiseXOR(F.col("marks_b")[i])) for i in range(MARKS // 64)), F.lit(0))
    return F.coalesce(bits <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6, F.lit(True))


def _marked(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose marks leave room for this similarity."""
    for k in "ab":
        pairs = pairs.join(marks.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("marks").alias(f"marks_{k}")), k, "left")
    return pairs.filter(_near(similarity)).select("a", "b")


def _share(similarity: float) -> Column:
    """Shingles that two similar sets of n_a and n_b at least have in common in their prefixes."""
    return F.floor(F.ceil(F.lit(similarity) * F.least("n_a", "n_b") - SLACK) / EACH) + 1


def _sharing(met: DataFrame) -> DataFrame:
    """(a, b) of rows (a, b, share), one for each list in which a pair meets: the pairs that meet in enough of them."""
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"), F.first("share").alias("share")).filter("lists >= share").select("a", "b")


def _sets(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(key, own): the shingles of the documents of these pairs."""

    def hashed(batches):
        for batch in pieces(batches, "text", 1 << 19):
            own = [shingles(t, shingle) for t in utf8(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), lists(np.concatenate(own), [len(x) for x in own], pa.int64())], ["key", "own"])

    named = C.staged(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "named")
    kind = T.StructType([T.StructField("key", T.LongType()), T.StructField("own", T.ArrayType(T.LongType()))])
    return C.staged(rows.join(_small(named), "key", "left_semi").mapInArrow(hashed, kind), "sets")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component of found (node, root)."""
    for k in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _mixed(lists: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, h, n, root, top, marks): the lists of several components of found (node, root), top being the largest in the list. The tables lists and marks go."""
    own = lists.join(found.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    own = C.staged(own, "rooted")
    _drop(lists)
    sizes = own.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("top"))
    mixed = C.staged(sizes.filter("roots > 1").select("h", F.col("top.root").alias("top")), "mixed")
    out = C.staged(own.join(mixed.hint("merge"), "h").join(marks.select("key", "marks").hint("merge"), "key", "left"), "mixed_lists")
    _drop(own, mixed, marks)
    return out


def _across(own: DataFrame, similarity: float) -> DataFrame:
    """(a, b) with a < b: the pairs of a list (see _mixed) in different components that may be similar. The largest component of a list meets the others of it alone."""
    a, b = (own.select("h", "top", *[F.col(c).alias(f"{c}_{k}") for c in ("key", "n", "marks", "root")]) for k in "ab")
    once = (F.col("key_a") < F.col("key_b")) | (F.col("root_b") == F.col("top"))
    both = a.filter("root_a != top").join(b.drop("top").hint("merge"), "h").filter((F.col("root_a") != F.col("root_b")) & once & _fits(similarity) & _near(similarity))
    return _sharing(both.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), _share(similarity).alias("share")))


def _after(rows: DataFrame) -> DataFrame:
    """key, n and x, the same of the row before it in its list (h) by n and key. Lists are cut into ranges (rows, see ranged), so a list of any length spans as many tasks as it
    needs; a range's first row has the row before it from the last one of the range before."""
    one = F.struct("h", "n", "key")
    ends = rows.groupBy("_task").agg(F.max(F.struct("_row", "h", "n", "key")).alias("x"))  # a row for each range
    ends = ends.select(F.lead("_task").over(W.orderBy("_task")).alias("_task"), F.struct("x.h", "x.n", "x.key").alias("end")).filter("_task IS NOT NULL")
    rows = rows.withColumn("x", F.lag(one).over(W.partitionBy("_task").orderBy("_row"))).join(F.broadcast(ends), "_task", "left")
    return rows.withColumn("x", F.when(F.col("_row") == 0, F.col("end")).otherwise(F.col("x"))).filter("x.h = h").select("key", "n", F.struct("x.key", "x.n").alias("x"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df, with all their columns, that stay: of each group of documents linked by similar pairs the one with the smallest id
    (null ids last; of rows that share it one, by their texts' hash). A null text counts as empty, and texts without words are copies."""
    rows = C.keyed(df, id_col, text_col, rows=True)
    found = linked(rows.select("key", "text"), shingle, similarity)
    gone = C.staged(found.filter("node != root").select(F.col("node").alias("key")), "gone")
    gone = F.broadcast(gone) if gone.count() * 24 <= C.BROADCAST_BYTES else gone
    return rows.join(gone, "key", "left_anti").select("row.*")
