"""Statistics over result tables (model, fold, metrics)."""

from __future__ import annotations

import math
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import scratch

#: Bins of a histogram that ranks are selected by, and bytes up to which the open ranks are broadcast.
BINS, SMALL = 1024, 32 << 20
#: Nodes of the rule that tails of distributions are summed by.
NODES = 48


def unioned(tiled: DataFrame, baseline: DataFrame) -> DataFrame:
    return tiled.unionByName(baseline, allowMissingColumns=True)


def fold_numbers(results: DataFrame) -> DataFrame:
    """fold as a number, from text such as fold_3."""
    return results.withColumn("fold", F.regexp_replace(F.col("fold").cast("string"), "[^0-9]", "").cast("int"))


def named(results: DataFrame, names: DataFrame) -> DataFrame:
    """results with the display name of their model, null where there is none."""
    return results.join(F.broadcast(names), "model", "left")


def long_form(results: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("model", "fold")) -> DataFrame:
    return results.unpivot(list(keys), metrics, "metric", "value")


def quantiles(df: DataFrame, value: str, at: list[float], keys: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """keys, n, low, high and, for each of at, q0, q1, ...: exact quantiles, linear between neighbours, of the finite values of each group.

    Ranks are selected by histograms that refine: each round counts, for every open rank, its values in bins between its bounds, and the bin that holds the rank gives
    the next bounds, the least and greatest value in it, until they are one. So what a group needs is one histogram for each rank, whatever its size, and no values are kept.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "quantiles")
    own, v = list(keys), F.col("_v")
    df.select(*own, F.col(value).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).write.parquet(f"{path}/values")
    rows = spark.read.parquet(f"{path}/values")
    groups = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).filter("n > 0")
    groups.write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in at for f in (F.floor, F.ceil)]))
    wanted, n = groups.select(*own, F.explode(ranks).alias("_rank"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.lit(0).cast("long").alias("_below")), 0
    while True:
        wanted.write.parquet(f"{path}/{n}")
        wanted = spark.read.parquet(f"{path}/{n}")
        left = wanted.filter("_low < _high")
        if not left.limit(1).count():
            break
        small = F.broadcast(left) if left.count() * 200 <= SMALL else left
        met = (rows.join(small, own) if own else rows.crossJoin(small)).filter((v >= F.col("_low")) & (v <= F.col("_high")))
        bin_ = F.least(F.floor((v - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1)).alias("_bin")
        counts = met.groupBy(*own, "_rank", "_below", bin_).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"))
        upto = F.sum("_n").over(W.partitionBy(*own, "_rank").orderBy("_bin"))
        found = counts.withColumn("_upto", F.col("_below") + upto).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        found = found.select(*own, "_rank", "_low", "_high", (F.col("_upto") - F.col("_n")).alias("_below"))
        wanted, n = found.unionByName(wanted.filter("_low >= _high")), n + 1
    known = wanted.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_low"))).alias("_known"))
    both = groups.join(known, own) if own else groups.crossJoin(known)

    def between(p: float):
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        return F.when(low == high, F.col("_known")[low]).otherwise((high - place(p)) * F.col("_known")[low] + (place(p) - low) * F.col("_known")[high])

    return both.select(*own, "n", "low", "high", *[between(p).alias(f"q{i}") for i, p in enumerate(at)])


def box_numbers(long: DataFrame, keys: tuple[str, ...] = ("model", "metric")) -> DataFrame:
    """Least, quartiles (linear between neighbours) and greatest; see quantiles. Groups without a value have no row."""
    own = quantiles(long, "value", [0.25, 0.5, 0.75], keys)
    return own.select(*keys, "low", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"), "high")


def anova(long: DataFrame, by: str = "model", keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """One-way analysis of variance of value by group: f (null where nothing varies within), df_between, df_within; see significance for p."""
    g = long.groupBy(*keys, by).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n_all"), F.lit(0.0))
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n_all") - F.col("k")))
    return t.select(*keys, f.alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n_all") - F.col("k")).alias("df_within"))


def nodes(n: int = NODES) -> list[tuple[float, float]]:
    """Places between 0 and 1 and weights of the Gauss-Legendre rule with n nodes."""
    x, w = np.polynomial.legendre.leggauss(n)
    return [(float(a), float(b)) for a, b in zip((x + 1) / 2, w / 2, strict=True)]


def _nodes():
    """The rule as an array column of fixed size: exploded, it makes a row for each node; folded, a sum over them."""
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in nodes()])


def significance(anovas: DataFrame) -> DataFrame:
    """anova rows with p, the chance of a greater f; null where f is.

    With tan(t)^2 = f df_between / df_within the tail is an integral of cos(t)^(df_within - 1) sin(t)^(df_between - 1) over the whole one. Its logarithm curves by
    df_between + df_within - 2 at least, so nine deviations around its peak hold all of it at any number of rows, and both integrals are sums over nodes."""
    d1, d2, half = F.col("df_between").cast("double"), F.col("df_within").cast("double"), F.lit(math.pi / 2)
    log = lambda t: (d2 - 1) * F.ln(F.greatest(F.cos(t), F.lit(1e-300))) + (d1 - 1) * F.ln(F.greatest(F.sin(t), F.lit(1e-300)))
    own = anovas.withColumn("_top", F.atan2(F.sqrt(d1 - 1), F.sqrt(d2 - 1))).withColumn("_far", F.coalesce(F.try_divide(F.lit(9.0), F.sqrt(d1 + d2 - 2)), half))
    own = own.withColumn("_from", F.atan2(F.sqrt(F.col("f") * d1), F.sqrt(d2)))
    top, far = F.col("_top"), F.col("_far")
    area = lambda low, high: F.aggregate(_nodes(), F.lit(0.0), lambda sum_, at: sum_ + at["w"] * F.exp(log(low + (high - low) * at["x"]) - log(top))) * (high - low)
    low, high = F.greatest(top - far, F.lit(0.0)), F.least(top + far, half)
    begin = F.greatest(F.col("_from"), low)
    tail = F.try_divide(area(begin, F.least(F.greatest(begin, top) + far, half)), area(low, high))
    return own.withColumn("p", F.when(F.col("f").isNotNull(), F.least(tail, F.lit(1.0)))).drop("_top", "_far", "_from")


def _groups(long: DataFrame, by: str, keys: tuple[str, ...]) -> DataFrame:
    return long.groupBy(*keys, by).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).filter("n > 0")


def tukey(long: DataFrame, by: str = "model", keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """keys, a, b (groups, a before b), difference (b's mean less a's), q and p: all pairs of groups by the studentised range.

    p is a double sum over nodes, of the scale (its density normalised by the same nodes) and of the greatest of k normals, around a sum over nodes for the normal
    between it and the range. Pairs are of groups, not of rows. Where nothing varies within, q is null and p is 1 for equal means, else 0; without degrees of freedom both are null."""
    own = long if keys else long.withColumn("_one", F.lit(1))
    on = list(keys) or ["_one"]
    g = _groups(own, by, tuple(on))
    total = g.groupBy(*on).agg(F.count(F.lit(1)).alias("_k"), (F.sum("n") - F.count(F.lit(1))).cast("double").alias("_df"), F.sum(F.col("n") * F.col("v")).alias("_within"))
    side = lambda name: g.select(*on, F.col(by).alias(name), F.col("n").alias(f"_n{name}"), F.col("m").alias(f"_m{name}"))
    pairs = side("a").join(side("b"), on).filter("a < b").join(total, on)
    spread = F.try_divide("_within", "_df")
    scale = F.sqrt(spread / 2 * (1 / F.col("_na") + 1 / F.col("_nb")))
    pairs = pairs.select(*on, "a", "b", (F.col("_mb") - F.col("_ma")).alias("difference"), scale.alias("_scale"), "_k", "_df")
    pairs = pairs.withColumn("q", F.try_divide(F.abs("difference"), F.col("_scale")))
    df, k, wide = F.col("_df"), F.col("_k"), F.try_divide(F.lit(9.0), F.sqrt(2 * F.col("_df")))
    low = F.greatest(1 - wide, F.lit(0.0))
    grid = pairs.withColumn("_s", F.explode(_nodes())).withColumn("_z", F.explode(_nodes()))
    grid = grid.withColumn("_at", low + (1 + wide - low) * F.col("_s.x")).withColumn("_top", 16 * F.col("_z.x") - 8)
    grid = grid.withColumn("_low", F.greatest(F.col("_top") - F.col("q") * F.col("_at"), F.lit(-9.0)))
    bell = lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    reach = F.col("_top") - F.col("_low")
    between = reach * F.aggregate(_nodes(), F.lit(0.0), lambda sum_, at: sum_ + at["w"] * bell(F.col("_low") + reach * at["x"]))
    weight = F.col("_s.w") * F.col("_z.w") * F.exp((df - 1) * F.ln("_at") - df * (F.col("_at") * F.col("_at") - 1) / 2)
    within = F.try_divide(F.sum(weight * 16 * k * bell(F.col("_top")) * F.pow(between, k - 1)), F.sum(weight))
    out = grid.groupBy(*on, "a", "b", "difference", "q", "_scale").agg(within.alias("_within"))
    p = F.when(F.col("_scale") > 0, F.greatest(F.least(1 - F.col("_within"), F.lit(1.0)), F.lit(0.0))).when(F.col("_scale") == 0, (F.col("difference") == 0).cast("double"))
    return out.select(*keys, "a", "b", "difference", "q", p.alias("p"))


def letters(means: dict, differ: set[tuple]) -> dict:
    """Compact letters: two groups share one if and only if they don't differ. means order the letters, largest first, equal ones by name."""
    names, unlike = sorted(means, key=lambda g: (-means[g], g)), {frozenset(p) for p in differ}
    sets = [set(names)]
    for pair in unlike:
        a, b = tuple(pair)
        sets = [x for s in sets for x in ((s - {a}, s - {b}) if {a, b} <= s else (s,))]
        sets = [s for i, s in enumerate(sets) if s and not any(s < o or (s == o and j < i) for j, o in enumerate(sets))]
    sets.sort(key=lambda s: sorted(names.index(x) for x in s))
    sign = lambda i: string.ascii_letters[i] if i < 52 else f"({i + 1})"
    return {n: "".join(sign(i) for i, s in enumerate(sets) if n in s) for n in names}


def lettered(long: DataFrame, by: str = "model", keys: tuple[str, ...] = ("metric",), level: float = 0.05) -> DataFrame:
    """keys, by, mean and letters: groups whose pair has p under level by tukey share no letter. A task holds the means and pairs of one set of keys, never its rows."""
    means = _groups(long, by, keys).select(*keys, F.col(by).alias("a"), F.lit(None).cast(long.schema[by].dataType).alias("b"), F.col("m").alias("mean"))
    differ = tukey(long, by, keys).filter(F.col("p") < level).select(*keys, "a", "b", F.lit(None).cast("double").alias("mean"))
    made = StructType([f for f in means.schema if f.name != "b"]).add("letters", "string")

    def spell(rows):
        pairs, own = rows[rows["b"].notna()], rows[rows["b"].isna()].drop(columns="b")
        got = letters(dict(zip(own["a"], own["mean"], strict=True)), set(zip(pairs["a"], pairs["b"], strict=True)))
        return own.assign(letters=[got[x] for x in own["a"]])

    return means.unionByName(differ).groupBy(*keys).applyInPandas(spell, made).withColumnRenamed("a", by)


def linear_fit(rows: DataFrame, keys: tuple[str, ...] = (), truth: str = "groundtruth", seen: str = "predicted") -> DataFrame:
    """Least squares of predicted on true counts; null where the truth is constant."""
    x, y = F.col(truth).cast("double"), F.col(seen).cast("double")
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return rows.groupBy(*keys).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))
