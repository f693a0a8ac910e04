import math
import random

import numpy as np
import pytest

from gridloom.operators import stats


@pytest.mark.parametrize("bins", [16, 1024])
def test_equal_to_sorting(spark, bins):
    r = random.Random(bins)
    groups = {"one": [3.5], "equal": [2.0] * 50, "ties": [r.choice([1.0, 1.0, 2.0, 7.25]) for _ in range(300)], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-9, 9) for _ in range(400)], "odd": [1.0, math.nan, None, 5.0, math.inf], None: [0.0, 1.0, 2.0, 3.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None)]
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x.g: x for x in stats.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", at, ("g",), bins).collect()}
    for g in ("one", "equal", "ties", "wide", "odd"):
        values = [v for v in groups[g] if v is not None and math.isfinite(v)]
        assert [got[g][f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(values, at).tolist(), rel=1e-12)
        assert (got[g].n, got[g].low, got[g].high) == (len(values), min(values), max(values))
    assert "none" not in got


def test_without_groups(spark):
    df = spark.range(1001).selectExpr("id * 2 AS v")
    assert stats.quantiles(df, "v", [0.5, 0.333]).first()[3:] == (1000.0, pytest.approx(666.0))
    assert stats.quantiles(df.limit(0), "v", [0.5]).collect() == []
