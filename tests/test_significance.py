"""Tails by nodes against simulation-free closed forms, published critical values and a plain numeric integral."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import stats


def tails(spark, rows):
    made = spark.createDataFrame(rows, "f double, df_between long, df_within long")
    return {(r.f, r.df_between, r.df_within): r.p for r in stats.significance(made).collect()}


def test_tail_of_f(spark):
    """Two groups within one: closed forms. Critical values at five and one per cent as tables print them. Many rows: the chi-squared limit."""
    got = tails(spark, [(3.885, 2, 12), (6.927, 2, 12), (161.448, 1, 1), (18.513, 1, 2), (4.0, 1, 1), (2.0, 2, 7), (0.0, 3, 9), (None, 2, 5), (2.5, 2, 1_000_000), (1e9, 4, 50), (0.5, 2, 1)])
    assert got[3.885, 2, 12] == pytest.approx(0.05, abs=5e-5) and got[6.927, 2, 12] == pytest.approx(0.01, abs=1e-5)
    assert got[161.448, 1, 1] == pytest.approx(0.05, abs=1e-6) and got[18.513, 1, 2] == pytest.approx(0.05, abs=1e-5)
    assert got[4.0, 1, 1] == pytest.approx(1 - 2 / math.pi * math.atan(2), abs=1e-12)
    for f, n in ((2.0, 7), (0.5, 1), (2.5, 1_000_000)):  # two degrees between: (1 + 2 f / n) ^ (-n / 2)
        assert got[f, 2, n] == pytest.approx((1 + 2 * f / n) ** (-n / 2), abs=1e-9)
    assert got[0.0, 3, 9] == pytest.approx(1) and got[None, 2, 5] is None and got[1e9, 4, 50] < 1e-12


def spread(spark, k, n, q):
    """k groups of n values with deviation one within, the last mean at q ranges from the others."""
    shape = np.array([(-1) ** i for i in range(n)]) * math.sqrt((n * k - k) / (n * k))  # so that the mean square within is 1
    rows = [(f"g{i:02d}", "m", float(v + (q / math.sqrt(n) if i == k - 1 else 0.0))) for i in range(k) for v in shape]
    return spark.createDataFrame(rows, "model string, metric string, value double")


@pytest.mark.parametrize("k, n, q, p", [(3, 4, 3.949, 0.05), (3, 4, 5.428, 0.01), (2, 6, 3.151, 0.05), (5, 4, 4.367, 0.05), (10, 2, 5.599, 0.05), (3, 4000, 3.314, 0.05), (4, 4000, 4.403, 0.01)])
def test_studentised_range(spark, k, n, q, p):
    """Critical values of printed tables; the last two those of infinite degrees of freedom."""
    got = stats.tukey(spread(spark, k, n, q)).filter(F.col("b") == f"g{k - 1:02d}").collect()
    assert len(got) == k - 1 and all(r.p == pytest.approx(p, abs=1e-4) and r.q == pytest.approx(q) and r.metric == "m" for r in got)


def test_nothing_varies(spark):
    rows = spark.createDataFrame([(m, "x", v) for m, v in (("a", 1.0), ("b", 1.0), ("c", 2.0)) for _ in range(3)] + [("a", "y", 1.0), ("b", "y", 2.0), ("c", "x", None)], "model string, metric string, value double")
    got = {(r.metric, r.a, r.b): (r.q, r.p) for r in stats.tukey(rows).collect()}
    assert got == {("x", "a", "b"): (None, 1.0), ("x", "a", "c"): (None, 0.0), ("x", "b", "c"): (None, 0.0), ("y", "a", "b"): (None, None)}
    assert stats.tukey(rows.limit(0)).collect() == [] and stats.lettered(rows.limit(0)).collect() == []
    assert {(r.metric, r.model): r.letters for r in stats.lettered(rows).collect()} == {("x", "c"): "a", ("x", "a"): "b", ("x", "b"): "b", ("y", "a"): "a", ("y", "b"): "a"}


def test_letters_against_all_subsets():
    r = random.Random(3)
    for _ in range(200):
        names = [f"n{i}" for i in range(r.randint(1, 6))]
        means = {n: float(r.randint(0, 3)) for n in names}
        differ = {p for p in itertools.combinations(names, 2) if r.random() < 0.4}
        own = stats.letters(means, differ)
        order = sorted(names, key=lambda n: (-means[n], n))
        free = [set(c) for k in range(1, len(names) + 1) for c in itertools.combinations(names, k) if not any(a in c and b in c for a, b in differ)]
        sets = sorted((s for s in free if not any(s < o for o in free)), key=lambda s: sorted(order.index(x) for x in s))
        assert own == {n: "".join(chr(97 + i) for i, s in enumerate(sets) if n in s) for n in names}
