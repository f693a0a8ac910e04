"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one marks, for each row's 64-bit hash, one bit of a wide filter of WIDE bits a row; only set bits move, summed in the tasks first. Bits that
two rows marked are possible repeats, and make up a small filter (see sieve), which is broadcast. Pass two tests each row where it is read: one that the
filter does not have is unique and passes straight through. Only the rest, true repeats and few false alarms, shuffle: they are grouped by
SHA-256, so false alarms cost time, never results. The filter has a bound at every size of input, so this plan is the same at every size.

Large groups: the group's id and size come from partial sums; its rows meet them in a sort-merge join that adaptive execution splits. Where texts
are kept, a second filter of the staying rows drops the others where they are read, so of each group one text moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .sieve import Sieve

#: Bits of the wide filter for a row: one in so many unique rows shuffles needlessly.
WIDE = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class Repeats:
    """The possible repeats among digests (a long column h): false alarms are possible, misses are not."""

    def __init__(self, digests: DataFrame, broadcast_bytes: int = C.BROADCAST_BYTES):
        self.bits = max(1, digests.count()) * WIDE
        marks = digests.select(F.pmod("h", F.lit(self.bits)).alias("bit"))
        twice = C.staged(marks.groupBy("bit").count().filter("count > 1").select(F.xxhash64("bit").alias("h")), "twice")
        self.sieve = Sieve(twice, twice.count(), broadcast_bytes)

    def marked(self, rows: DataFrame) -> DataFrame:
        """rows (with a long column h) and a boolean column again: false only where no other row has this h."""
        return self.sieve.marked(rows, F.xxhash64(F.pmod("h", F.lit(self.bits))))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = C.BROADCAST_BYTES) -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; a null text counts as empty. keep_id is the
    smallest id of the group; null ids are never the smallest, and a group without any id has keep_id null. kept: the row has the id
    keep_id, so rows that repeat the staying row's id are all marked (drop_exact_duplicates leaves one). An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    text = normalised(C.col(text_col))
    digests = C.staged(df.select(C.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("h")), "digests")
    tested = Repeats(digests, broadcast_bytes).marked(digests)
    rest = tested.filter("again").select("id", "sha")
    groups = C.staged(rest.groupBy("sha").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    shared = rest.join(groups.hint("merge"), "sha").select("id", "keep_id", "group_size", "sha")
    single = tested.filter(~F.col("again")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    rows = single.unionByName(shared)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = C.BROADCAST_BYTES) -> DataFrame:
    """The rows of df, with all their columns, that stay: of equal texts one row, that with the smallest id.

    Unique rows go from the scan to the result, and rows that surely do not stay end there. Ties in the id leave any one of the tied rows. Null
    ids come after all others.
    """
    rows = C.packed(df, id_col, text_col)
    text = normalised(F.col("text"))
    rows = rows.select("row", "id", F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("sha"))
    digests = C.staged(rows.select("id", "h", "sha"), "digests")
    repeats = Repeats(digests, broadcast_bytes)
    groups = repeats.marked(digests).filter("again").groupBy("sha").agg(F.min("id").alias("keep"))
    groups = C.staged(groups, "groups")
    staying = Sieve(groups.select(F.xxhash64("keep", "sha").alias("h")), groups.count(), broadcast_bytes)
    tested = repeats.marked(rows)
    single = tested.filter(~F.col("again")).select("row")
    rest = staying.marked(tested.filter("again").drop("again"), F.xxhash64("id", "sha")).filter("again").select("row", "id", "sha")
    first = rest.join(groups.hint("merge"), "sha").filter(F.col("id").eqNullSafe(F.col("keep")))
    return single.unionByName(first.dropDuplicates(["sha"]).select("row")).select("row.*")


ORACLE = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
