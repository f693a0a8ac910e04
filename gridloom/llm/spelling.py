"""Spelling variants through a dictionary of trie-node pairs.

Words are counted in the tasks first, so only distinct words of a batch move. The nodes of the forward trie (prefixes) and of the reversed trie
(suffixes) get numbers; a word and one of its positions then are a pair of integers, the node before and the node after. Two words that differ in the letter at
one position have the same pair around it; a word without one of its letters has the pair of the shorter word cut at that place. So groups by pairs hold exactly the
words one edit apart, each link once: of a run of equal letters only the first is left out. A group has a word for each letter of the
alphabet at most, so it is bounded by the alphabet, whatever the number of words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .arrow import column, pieces, utf8

LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: One occurrence in so many, by its hash, loses a letter.
MARRED = 199
#: Bytes up to which a trie node is named by its string; longer strings by their SHA-256, so that names grow with a word's length, not with its square.
NAMED = 31

_RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")


def word_counts(rows: DataFrame, letters: int = LETTERS, marred: int = MARRED) -> DataFrame:
    """rows (id, text): (word, n) of runs of A-Z, a-z and U+00C0 to U+00FF, A to Z in lower case, with `letters` code points or more. Where `marred` divides the
    CRC-32 of "<id>:<run>" the run loses the code point at that number modulo its length. A null id is the empty string; a null text has none."""

    def count(batches):
        for batch in pieces(batches, "text", 8 << 20):
            total: Counter = Counter()
            for i, text in zip(column(batch, "id").to_pylist(), utf8(column(batch, "text")), strict=True):
                start = b"%s:" % (b"" if i is None else str(i).encode())
                for run, n in Counter(_RUN.findall(text.lower().decode(errors="replace"))).items():
                    if len(run) < letters:
                        continue  # with a letter less it is too short all the more
                    h = zlib.crc32(start + run.encode())
                    if not h % marred:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < letters:
                            continue
                    total[run] += n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return rows.select("id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _names(letters) -> list[bytes]:
    """Names of the trie nodes along these letters, from the root on."""
    out, path, digest = [b""], b"", None
    for x in letters:
        x = x.encode()
        if digest is None and len(path) + len(x) <= NAMED:
            path += x
            out.append(path)
        else:
            digest = digest or hashlib.sha256(path)
            digest.update(x)
            out.append(digest.digest())
    return out


def _cuts(words: DataFrame) -> DataFrame:
    """words (wid, word, n) to a row for each place before, between and after its letters: the names of the nodes before it (p), after it (s) and after the
    next letter (skip, null at the end), and whether that letter starts a run."""

    def cut(batches):
        names = ["wid", "n", "p", "s", "skip", "start"]
        for batch in pieces(batches, "word", 1 << 16):
            out: list[list] = [[] for _ in names]
            for wid, word, n in zip(*(column(batch, c).to_pylist() for c in ("wid", "word", "n")), strict=True):
                before, after = _names(word), _names(word[::-1])[::-1]
                for values, more in zip(out, ([wid] * len(before), [n] * len(before), before, after, [*after[1:], None], [i == 0 or x != word[i - 1] for i, x in enumerate(word)] + [True]), strict=True):
                    values += more
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names)

    return words.mapInArrow(cut, "wid long, n long, p binary, s binary, skip binary, start boolean")


def _numbered(names: DataFrame, label: str) -> DataFrame:
    """A number for each name (a column `name`) of a node that two words or more go through, broadcast where the table is small. The other nodes, the lonely
    ends of words, join no two words."""
    shared = names.groupBy("name").agg(F.count(F.lit(1)).alias("words")).filter("words > 1")
    out = C.staged(shared.select("name", F.monotonically_increasing_id().alias("node")), label)
    return _small(out, NAMED + 49)


def _small(table: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(table) if table.count() * row_bytes <= C.BROADCAST_BYTES else table.hint("merge")


def neighbours(words: DataFrame) -> DataFrame:
    """words (wid, word, n; wid in code-point order): wid, n_near and best, a struct of the near word of largest n (v: minus its n, then by its wid). Words without
    near ones have no row."""
    cuts = C.staged(_cuts(words), "cuts")
    forward, reverse = _numbered(cuts.select(F.col("p").alias("name")), "forward"), _numbered(cuts.select(F.col("s").alias("name")), "reverse")
    at = lambda nodes, name: nodes.select(F.col("name").alias(name), F.col("node").alias(f"{name}_node"))
    placed = cuts.join(at(forward, "p"), "p").drop("p").join(at(reverse, "s"), "s", "left").drop("s").join(at(reverse, "skip"), "skip", "left")
    # Whole: the word itself, cut here. Else: the word without the next letter.
    each = F.array(F.struct(F.col("s_node").alias("s"), F.lit(True).alias("whole")), F.struct(F.col("skip_node").alias("s"), F.lit(False).alias("whole")))
    pairs = placed.select(F.col("p_node").alias("p"), "wid", "n", "start", F.explode(each).alias("x")).filter("x.s IS NOT NULL")
    one = F.struct(F.col("x.whole").alias("whole"), (F.col("x.whole") | F.col("start")).alias("start"), "n", "wid")
    groups = pairs.groupBy("p", "x.s").agg(F.collect_list(one).alias("all")).filter(F.size("all") > 1)
    x = F.col("x")
    near = F.filter("all", lambda y: (y.wid != x.wid) & F.when(x.whole == y.whole, ~x.whole).otherwise(x.start & y.start))
    found = groups.select("all", F.explode("all").alias("x")).select(x.wid.alias("wid"), near.alias("near")).filter(F.size("near") > 0)
    best = F.array_min(F.transform("near", lambda y: F.struct((-y.n).alias("v"), y.wid.alias("wid"))))
    return found.groupBy("wid").agg(F.sum(F.size("near")).alias("n_near"), F.min(best).alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """links (wid, root) of words to their forms, with every step replaced by the last one: each round doubles the steps, and n grows with each step."""
    while True:
        after = _small(links.select(F.col("wid").alias("root"), F.col("root").alias("next")), 24)
        further = C.staged(links.join(after, "root", "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = further.select("wid", "root")
        if not further.filter("moved").limit(1).count():
            return links


def spelling_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, least: int = MIN_COUNT, ratio: int = RATIO, marred: int = MARRED) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of `letters` code points or more with `least` occurrences or more; see word_counts for the words.

    Near words differ in exactly one inserted, deleted or replaced code point. form: the near word of largest n (ties: the smallest in code-point order), if
    that is `ratio` times the word's n or more, else null; root: where the forms lead, the word itself if nowhere. Repeated rows count each; null and empty
    texts have no words; an empty table gives no rows; other columns are ignored, whatever their names. Words of any length are compared whole.
    """
    rows = df.select(C.col(id_col).alias("id"), C.col(text_col).cast("string").alias("text"))
    counted = C.staged(word_counts(rows, letters, marred).filter(F.col("n") >= least), "counted")
    words = C.staged(counted.orderBy("word").select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")
    near = C.staged(neighbours(words), "near")
    found = words.join(_small(near, 48), "wid", "left")
    linked = F.when(-F.col("best.v") >= F.col("n") * ratio, F.col("best.wid"))
    found = C.staged(found.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), linked.alias("form_id")), "found")
    roots = _roots(found.filter("form_id IS NOT NULL").select("wid", F.col("form_id").alias("root")))
    long = words.agg(F.max(F.octet_length("word"))).first()[0] or 0
    named = _small(words, long + 48)
    form = named.select(F.col("wid").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = named.select(F.col("wid").alias("root_id"), F.col("word").alias("root"))
    out = found.join(_small(roots.withColumnRenamed("root", "root_id"), 24), "wid", "left").join(form, "form_id", "left").join(root, "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
WITH crc AS (SELECT list(list_reduce(list_prepend(CAST(i AS bigint), range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
  WHERE len(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, k, [CAST(('0x' || substr(x, 2 * i - 1, 2)) AS bigint) for i in range(1, len(x) // 2 + 1)] AS b FROM (SELECT run, k, hex(encode(doc_id || ':' || run)) AS x FROM runs)),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h FROM bytes, crc),
words AS (SELECT w AS word, CAST(sum(k) AS bigint) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS w FROM hashed) WHERE len(w) >= 6 GROUP BY w HAVING sum(k) >= 5),
cuts AS (SELECT word, n, len(word) AS l, CAST(i AS bigint) AS i FROM (SELECT word, n, unnest(range(0, len(word))) AS i FROM words)),
less AS (SELECT word, n, l, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM cuts),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.p = b.p AND a.s = b.s WHERE a.word != b.word AND a.l = b.l
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.p || a.s = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.p || a.s = b.word),
best AS (SELECT word, count(*) AS n_near, min({'v': -m, 'w': other}) AS x FROM near GROUP BY word),
forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.v >= 5 * n THEN x.w END AS form, CASE WHEN -x.v >= 5 * n THEN -x.v END AS form_n FROM words LEFT JOIN best ON best.word = words.word),
chain AS (SELECT word, word AS root, form AS further FROM forms),
c1 AS (SELECT a.word, coalesce(a.further, a.root) AS root, b.form AS further FROM chain a LEFT JOIN forms b ON a.further = b.word),
c2 AS (SELECT a.word, coalesce(a.further, a.root) AS root, b.form AS further FROM c1 a LEFT JOIN forms b ON a.further = b.word),
c3 AS (SELECT a.word, coalesce(a.further, a.root) AS root, b.form AS further FROM c2 a LEFT JOIN forms b ON a.further = b.word),
c4 AS (SELECT a.word, coalesce(a.further, a.root) AS root, b.form AS further FROM c3 a LEFT JOIN forms b ON a.further = b.word),
c5 AS (SELECT a.word, coalesce(a.further, a.root) AS root, b.form AS further FROM c4 a LEFT JOIN forms b ON a.further = b.word),
c6 AS (SELECT a.word, coalesce(a.further, a.root) AS root, b.form AS further FROM c5 a LEFT JOIN forms b ON a.further = b.word),
c7 AS (SELECT a.word, coalesce(a.further, a.root) AS root, b.form AS further FROM c6 a LEFT JOIN forms b ON a.further = b.word),
c8 AS (SELECT a.word, coalesce(a.further, a.root) AS root, b.form AS further FROM c7 a LEFT JOIN forms b ON a.further = b.word)
SELECT forms.word, form, c8.root, n, n_near, CAST(form_n AS bigint) AS form_n FROM forms JOIN c8 ON c8.word = forms.word
"""
