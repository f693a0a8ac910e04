"""Line dedup by winnowing over line hashes, in DataFrame functions only.

1. Of every `run` consecutive full lines the gram of lines with the smallest hash is selected, leftmost on ties: equal runs of that many lines
   are thus guaranteed to select the same fingerprint at the same place. A document's selected fingerprints are its seeds.
2. Fingerprints with one place in the corpus are dropped: a filter of the others (see sieve) is tested where the seeds are made.
3. The places of a fingerprint are joined: each seed is extended by every number of lines to its left and the rest of `run` lines to its right,
   as far as the windows reach that selected it, and the lines themselves are compared (they are the key of a group, not their hash). The first
   place of an extension stays; later ones are matches.
4. Matches that overlap or touch are one run of a later document, which is cut out of it.

First places are partial sums, and meet their rows in joins that adaptive execution splits, so a line of a third of all documents does not gather
in one task. Documents without a match never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .sieve import Sieve

RUN, GRAM = 2, 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _full(lines: Column) -> Column:
    """(at, line) of the lines that aren't blank."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")


def seeds(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """docs (key, text) to a row for each selected fingerprint: key, gram (its hash), start (of the first window that selected it, among full
    lines) and context: (at, line) of the lines of all windows that selected it.

    Arrays that lambdas read are columns that their projection names twice, so they are not evaluated anew for each element.
    """
    own = docs.select("key", _full(_lines(F.col("text"))).alias("full")).filter(F.size("full") >= run)
    own = own.select("key", "full", F.transform("full", lambda x: F.xxhash64(x["line"])).alias("one"))
    if gram > 1:
        grams = F.transform(F.sequence(F.lit(1), F.size("one") - (gram - 1)), lambda i: F.xxhash64(F.slice("one", i, gram)))
    else:
        grams = F.col("one")
    own = own.select("key", "full", grams.alias("grams"))

    def least(i: Column) -> Column:
        return F.array_min(F.transform(F.sequence(i, i + (run - gram)), lambda j: F.struct(F.element_at("grams", j), j.alias("place"))))["place"]

    own = own.select("key", "full", "grams", F.transform(F.sequence(F.lit(1), F.size("full") - (run - 1)), least).alias("chosen"))
    numbered = F.transform("chosen", lambda p, i: F.struct(i.alias("start"), p.alias("place"), F.get("chosen", i - 1).alias("left")))
    heads = F.filter(numbered, lambda x: x["left"].isNull() | (x["left"] != x["place"]))
    own = own.select("key", "full", "grams", F.size("chosen").alias("windows"), heads.alias("heads"))

    def seed(x: Column, i: Column) -> Column:
        after = F.coalesce(F.get("heads", i + 1)["start"], F.col("windows"))
        return F.struct(F.element_at("grams", x["place"]).alias("gram"), x["start"].alias("start"), F.slice("full", x["start"] + 1, after - x["start"] + (run - 1)).alias("context"))

    return own.select("key", F.inline(F.transform("heads", seed)))


def matches(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """(key, at): the numbers of the lines of each later place of `run` equal full lines (smaller key, or before in the same document)."""
    found = seeds(docs, run, gram)
    again = C.staged(found.groupBy("gram").count().filter("count > 1").select(F.col("gram").alias("h")), "prints")
    found = Sieve(again, again.count()).marked(found, F.col("gram")).filter("again")
    offsets = F.sequence(F.lit(0), F.size("context") - run)

    def extended(left: Column) -> Column:
        own = F.slice("context", left + 1, run)
        return F.struct((F.col("start") + left).alias("start"), own["at"].alias("at"), F.array_join(own["line"], "\n").alias("lines"))

    rows = C.staged(found.select("key", F.inline(F.transform(offsets, extended))), "extended")
    firsts = rows.groupBy("lines").agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = C.staged(firsts.select("lines", "first"), "firsts")
    return rows.join(firsts.hint("merge"), "lines").filter(F.struct("key", "start") != F.col("first")).select("key", F.explode("at").alias("at"))


def drop_repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, gram: int = GRAM) -> DataFrame:
    """One row for each row of df: id_col, n_lines, n_removed, kept (the text without the removed lines).

    Lines end at newlines; blank ones (spaces alone) are never removed and do not break a run. A line goes if `run` consecutive full lines
    with it also start earlier: in a document with a smaller id, or before in the same one. Null counts as an empty text, which is one blank line.
    Repeated ids and null ids (last) follow each other in an order fixed by keyed(). An empty table gives no rows.
    """
    docs = C.keyed(df, id_col, text_col)
    gone = C.staged(matches(docs, run, gram).groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("gone")), "gone")
    tested = Sieve(gone.select(F.xxhash64("key").alias("h")), gone.count()).marked(docs, F.xxhash64("key"))
    n, text = F.size("lines"), F.coalesce("text", F.lit(""))
    whole = tested.filter(~F.col("again")).select("id", F.size(_lines(F.col("text"))).alias("n"), F.lit(0).alias("n_removed"), text.alias("kept"))
    cut = tested.filter("again").select("key", "id", _lines(F.col("text")).alias("lines")).join(gone, "key", "left")
    cut = cut.select("id", "lines", F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("gone"))
    # What stays between two removed lines is one slice, so a text takes time in proportion to its lines.
    between = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.struct((F.coalesce(F.get("gone", i - 1), F.lit(-1)) + 1).alias("a"), F.coalesce(F.get("gone", i), n).alias("b")))
    kept = F.array_join(F.flatten(F.transform(between, lambda s: F.slice("lines", s["a"] + 1, s["b"] - s["a"]))), "\n")
    rows = whole.unionByName(cut.select("id", n.alias("n"), F.size("gone").alias("n_removed"), kept.alias("kept")))
    return rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "kept")


def digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM l WHERE trim(line, ' ') <> ''),
w AS (SELECT a.doc_id, a.p, a.line || chr(10) || b.line AS s FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.p = a.p + {RUN - 1}),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + {RUN})) AS p FROM r),
x AS (SELECT l.doc_id, l.line, l.pos, g.p IS NOT NULL AS gone FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND l.pos = f.pos LEFT JOIN g ON g.doc_id = f.doc_id AND g.p = f.p)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""

#: The rows of run = 1: each line that isn't blank and also stands earlier goes, whatever its neighbours are.
EVERY_ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
x AS (SELECT *, trim(line, ' ') <> '' AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
