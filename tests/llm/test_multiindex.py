import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import multiindex

SCHEMA = "vec_id long, embedding array<float>, v string, cell int"


def inner(a, b):
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        total += x * y
    return total


def brute(rows, k=20, every=20):
    """Of (id, vector): for each query (id, score) of the k nearest, and all scores."""
    full = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            full[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in (i for i in full if i % every == 0):
        scored = sorted((-inner(full[q], v), i) for i, v in full.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(multiindex.nearest_neighbours(df, F.col("id") % 20 == 0, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return out


def vectors(n, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 6))
    return [(i, (centres[r.integers(12)] + 0.6 * r.normal(size=6)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("bucket", "visits"), [(8192, 8192), (50, 7)])
def test_recall_and_exact_scores(spark, bucket, visits):
    rows = vectors(3000)
    same = [3 * x for x in rows[7][1]]
    rows += [(10_000 + i, same) for i in range(300)] + [(None, same), (20_000, None), (20_020, [0.0] * 6), (20_040, [1.0, None, 1, 1, 1, 1]), (20_060, [1.0, math.nan, 1, 1, 1, 1]), (20_080, [1.0, math.inf, 1, 1, 1, 1]), (20_100, [1.0] * 5), (20, rows[20][1])]
    want, got = brute(rows), run(spark, rows, bucket=bucket, visits=visits)
    assert set(got) == set(want)
    for q, found in got.items():
        assert len(found) == 20 == len({i for i, _ in found}) and q not in dict(found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    scores = {(q, i): s for q, v in brute(rows, k=10**6).items() for i, s in v}
    assert all(s == scores[q, i] for q, v in got.items() for i, s in v)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    assert got[10_000] == want[10_000] and {i for i, _ in got[10_000]} == set(range(10_001, 10_021))  # all ties


def test_fewer_than_wanted(spark):
    few = vectors(9, 3)
    assert run(spark, few) == brute(few)  # fewer than k others


def test_equal_vectors_alone(spark):
    rows = [(i, [1.0, 2, 3, 4, 5, 6]) for i in range(100)]
    assert run(spark, rows) == brute(rows)


def test_nothing(spark):
    assert run(spark, []) == {} and run(spark, [(1, None), (0, [0.0] * 6)]) == {} and run(spark, [(0, [1.0] * 6)]) == {} and run(spark, [(1, [1.0] * 6), (2, [2.0] * 6)]) == {}


def test_traversal_is_in_order():
    r = np.random.default_rng(4)
    for _ in range(50):
        one, two, counts = r.normal(size=7), r.normal(size=5), r.integers(0, 4, 35)
        got = multiindex.traverse(one, two, counts, 25)
        sums = (one[:, None] + two[None, :]).ravel()
        order = [c for c in np.argsort(sums, kind="stable").tolist() if counts[c]]
        n = int(np.searchsorted(np.cumsum(counts[order]), 25)) + 1
        assert got == order[:n]


def test_buckets_are_bounded():
    counts = np.array([0, 5, 3, 40, 0, 9, 2, 2, 100])
    b = multiindex.Buckets(counts, 10)
    load = {}
    for c, n in enumerate(counts):
        for at in range(b.first[c], b.first[c] + b.parts[c]):
            load[at] = load.get(at, 0) + n / b.parts[c]
    assert max(load.values()) <= 10
    at, cells = b.visits([8, 1, 3])
    assert (np.diff(at) >= 0).all() and len(at) == 1 + 4 + 10
