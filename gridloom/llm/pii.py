"""Personal data by candidate gradient boosting, in DataFrame functions only and without a shuffle.

Exact patterns give the base spans. High-recall generators propose further spans, which may overlap: obfuscated mail addresses, addresses of
version 6, single card numbers in longer runs of digits, national telephone numbers. Boosted trees score each by its format and by what stands
around it, and a calibrated threshold for each kind selects those that are added. The trees are fitted on the driver on EXAMPLES made texts, whose
features come from the same expressions.

Places of matches come from what lies between them: splitting at a pattern gives the gaps, extracting it the matches, and running sums of
their lengths the code points. Patterns use possessive repeats, which Java's engine runs without recursion, and start only where a run of
their first characters starts or the match before ended, which are the only places where a leftmost match can start; so long runs take linear time.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .boosting import Boosted

KINDS = ("email", "ip", "card", "phone")
#: Made texts that the trees are fitted on, half of them for calibration; precision that a kind's threshold must reach on that half.
EXAMPLES, PRECISION = 1200, 0.98
#: Features of a candidate.
COUNT = 15
#: Matches that are placed, or compared with others, at a time.
BLOCK = 64
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_FOUND = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(](?:at|AT)[\])]\x20?|@)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[\x20-]?[0-9]{4}){3}|3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])",
}
#: A text without this has no match of the kind, base or found.
_NEEDS = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]|[0-9]{3}"}
_CUES = {"email": "(?i)mail|contact|write", "ip": r"(?i)\bip\b|address|host|server|addr", "card": "(?i)card|visa|karte|carte|tarjeta|credit", "phone": "(?i)tel|phone|fon|call|mobile|fax|m.vil"}
_AGAINST = r"(?i)token|key|hash|isbn|version|\bv\z|order|invoice|\bref|\bno\b|\bnr\b|\bid\b|sha|=|#|\$|€"


def _parts(text: Column, pattern: str) -> Column:
    """The leftmost matches and what lies between them."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))


def with_matches(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """rows and, for each name, an array of (start, end, match, before, after) of the matches in its parts (null: none): code points, and what stands next to the match.

    A text takes time in proportion to its length: places are sums within blocks of matches, from the sums of the blocks before. What lambdas read are columns that
    their projection names twice, so nothing is evaluated anew for each match.
    """
    own, made = [C.col(c) for c in rows.columns], {k: f"_{i}" for i, k in enumerate(parts)}
    rows = rows.select(*own, *[parts[k].alias(f"parts{n}") for k, n in made.items()])

    def pairs(n: str) -> Column:
        found, gaps = F.col(f"parts{n}.found"), F.col(f"parts{n}.gaps")
        each = F.transform(found, lambda m, i: F.struct(m.alias("match"), F.element_at(gaps, i + 1).alias("gap"), F.left(F.element_at(gaps, i + 2), F.lit(2)).alias("after")))
        return F.when(F.size(found) > 0, each).otherwise(F.expr("cast(array() as array<struct<match:string,gap:string,after:string>>)"))

    rows = rows.select(*own, *[pairs(n).alias(f"pairs{n}") for n in made.values()])

    def before(n: str) -> Column:
        """The code points before each block, and after the last."""
        all_ = F.col(f"pairs{n}")
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) + (BLOCK - 1)) / BLOCK).cast("int") - 1)
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(all_, b * BLOCK + 1, BLOCK), F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["match"])))
        return F.when(F.size(all_) > 0, F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))).otherwise(F.array(F.lit(0)))

    rows = rows.select(*own, *[c for n in made.values() for c in (F.col(f"pairs{n}"), before(n).alias(f"before{n}"))])
    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string,before:string,after:string>>)")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"), F.right(pair["gap"], F.lit(24)).alias("before"), pair["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def placed(n: str) -> Column:
        all_, at = F.col(f"pairs{n}"), F.col(f"before{n}")
        blocks = F.when(F.size(at) > 1, F.sequence(F.lit(0), F.size(at) - 2)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.flatten(F.transform(blocks, lambda b: F.aggregate(F.slice(all_, b * BLOCK + 1, BLOCK), F.struct(F.element_at(at, b + 1).alias("at"), empty.alias("out")), step, lambda s: s["out"])))

    return rows.select(*own, *[placed(n).alias(k) for k, n in made.items()])


def _apart(chosen: str, base: str) -> Column:
    """The spans of chosen (by start) that touch none of base. Both are columns; a block of chosen spans meets only the base spans in its reach."""
    own, other = F.col(chosen), F.col(base)
    blocks = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    def free(block: Column) -> Column:
        first, last = F.array_min(F.transform(block, lambda x: x["start"])), F.array_max(F.transform(block, lambda x: x["end"]))
        reach = F.transform(F.array(F.struct(first.alias("a"), last.alias("b"))), lambda r: F.filter(other, lambda s: (s["start"] < r["b"]) & (r["a"] < s["end"])))
        return F.flatten(F.transform(reach, lambda near: F.filter(block, lambda c: ~F.exists(near, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))))

    return F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(F.array(F.slice(own, b * BLOCK + 1, BLOCK)), free))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _edge(c: Column) -> Column:
    return F.when(c.isin("", " ", "\n", "\t"), 0).when(c.rlike("[\"'=#]"), 3).when(c.rlike("[0-9A-Za-z]"), 2).otherwise(1)


def _features(kind: str, c: Column) -> list[Column]:
    m, digits = c["match"], _digits(c["match"])
    return [
        F.length(m), F.length(digits), F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")), F.call_function("luhn_check", digits).cast("int"),
        F.size(F.array_distinct(F.split(digits, ""))), _edge(F.right(c["before"], F.lit(1))), _edge(F.left(c["after"], F.lit(1))),
        c["before"].rlike(_CUES[kind]).cast("int"), c["before"].rlike(_AGAINST).cast("int"), m.rlike(r"^\(|^00").cast("int"),
        m.rlike("[.:]").cast("int"), m.rlike(r"(?i)[\[(](at|dot)").cast("int"), m.rlike(r"(?i)[a-z]{2,}$").cast("int"),
        m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$|:").cast("int"), m.rlike("^(19|20)[0-9]{2}[ .-]").cast("int"),
    ]


def made_texts(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, str, int]]:
    """(kind, text, label): one candidate of the kind in each text, personal (1) or not (0), in made surroundings."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice(["the", "an", "or", "ti", "sch", "ung", "eau", "la"]) for _ in range(r.randint(1, 3)))

    def card(good):
        digits = r.choice("3456") + d(14)
        check = next(c for c in "0123456789" if _luhn(digits + c) == good)
        own = digits + check
        return own if r.random() < 0.6 else r.choice("- ").join(own[i : i + 4] for i in range(0, 16, 4))

    yes = {
        "email": lambda: f"{w()}{r.choice(['.', '', '_'])}{w()}{r.choice([' [at] ', '(at)', ' (at) ', '@'])}{w()}{r.choice(['.', ' [dot] ', '(dot)'])}{r.choice(['com', 'org', 'de'])}",
        "ip": lambda: r.choice([":".join("%x" % r.randint(0, 65535) for _ in range(8)), ".".join(str(r.randint(0, 255)) for _ in range(4))]),
        "card": lambda: card(True),
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0049 {d(3)} {d(3)} {d(4)}", f"00{d(2)}-{d(3)}-{d(3)}{d(4)}"]),
    }
    no = {
        "email": lambda: f"{w()}@{d(2)}.{d(1)}",
        "ip": lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)),
        "card": lambda: card(False),
        "phone": lambda: r.choice([f"19{d(2)}-20{d(2)} {d(4)}", f"20{d(2)}-0{d(3)}-{d(4)}", f"{d(2)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{d(2)}.{d(3)}.{d(3)}"]),
    }
    cue = {"email": "mail: ", "ip": "host ", "card": "card ", "phone": "tel. "}
    out = []
    for i in range(n):
        kind, label = KINDS[i % 4], r.random() < 0.5
        before = r.choice([cue[kind], "", "", ""]) if label else r.choice(["order no ", "token = ", "version ", "ref #", "isbn ", "", "", ""])
        against = not label and kind in ("ip", "phone") and before != "" and r.random() < 0.5
        out.append((kind, f"{w()} {w()} {before}{(yes if label or against else no)[kind]()}{r.choice(['', '.', ','])} {w()} {w()}", int(label)))
    return out


def _luhn(s: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


@functools.cache
def _trained(spark: SparkSession) -> dict[str, tuple[Boosted, float]]:
    rows = spark.createDataFrame(made_texts(), "kind string, text string, label int")
    out = {}
    for kind in KINDS:
        found = with_matches(rows.filter(F.col("kind") == kind), {"found": _parts(F.col("text"), _FOUND[kind])}).select("label", F.explode("found").alias("c"))
        got = np.array([[r[0], *r[1]] for r in found.select("label", F.array(*[f.cast("double") for f in _features(kind, F.col("c"))])).collect()])
        y, x, half = got[:, 0], got[:, 1:], len(got) // 2
        model = Boosted().fit(x[:half], y[:half], x[half:], y[half:])
        p, truth = model.probability(x[half:]), y[half:]
        cuts = [t for t in np.unique(p) if truth[p >= t].mean() >= PRECISION]
        out[kind] = (model, max(0.5, float(min(cuts, default=2.0))))
    return out


def annotated(df: DataFrame, text: Column, carried: list[Column]) -> DataFrame:
    """carried columns, text (null as empty), base and spans: arrays of (kind number, start, end), in that order, without repeats."""
    trained = _trained(df.sparkSession)
    rows = df.select(*carried, F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    rows = with_matches(rows, {f"{name}_{k}": F.when(F.col("text").rlike(_NEEDS[k]), _parts(F.col("text"), p[k])) for name, p in (("base", _BASE), ("found", _FOUND)) for k in KINDS})

    def span(i: int):
        return lambda c: F.struct(F.lit(i).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))

    base = F.concat(*[F.transform(F.filter(f"base_{k}", functools.partial(_valid_of, k)), span(i)) for i, k in enumerate(KINDS)])
    chosen = F.concat(*[F.transform(F.filter(F.transform(f"found_{k}", functools.partial(_described, k)), functools.partial(_chosen, trained[k])), span(i)) for i, k in enumerate(KINDS)])
    own = [C.col(c) for c in rows.columns if not c.startswith(("base_", "found_"))]
    rows = rows.select(*own, base.alias("base"), chosen.alias("chosen"))
    by_start = F.array_sort(F.transform(F.array_except("chosen", "base"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    rows = rows.select(*own, "base", by_start.alias("chosen"))
    added = F.transform(_apart("chosen", "base"), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select(*own, "base", F.array_sort(F.array_distinct(F.concat("base", added))).alias("spans"))


def _same(value: int, c: Column) -> Column:
    return c == value


def _valid_of(kind: str, c: Column) -> Column:
    return _valid(kind, c["match"])


def _described(kind: str, c: Column) -> Column:
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.array(*[f.cast("int") for f in _features(kind, c)]).alias("features"))


def _chosen(trained: tuple[Boosted, float], c: Column) -> Column:
    return trained[0].column([c["features"][i] for i in range(COUNT)]) >= trained[1]


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end, comma-joined).

    A null text counts as empty and has no spans. Spans are code points, the end exclusive, by kind and then start. Selected candidates that touch no
    base span are added; base spans always stay, and those of different kinds may overlap. Repeated rows get equal results; an empty table gives no rows.
    """
    found = annotated(df, C.col(text_col), [C.col(id_col).alias("id")])
    counts = [F.size(F.filter(F.col("base")["kind"], functools.partial(_same, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with each span (overlapping ones as one, named after the first) of text_col replaced by its kind in brackets. Null stays null."""
    rows = C.packed(df, id_col, text_col)
    found = annotated(rows, F.col("text"), [F.col("row")])
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"))

    out = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.select("row", F.when(F.col("row")[text_col].isNotNull(), out).alias("out")).select(*[(F.col("out") if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])
