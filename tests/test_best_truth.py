import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import prefix
from gridloom.operators import matching, suppression
from gridloom.plans import fixture as X
from tests.test_metrics import GT, truth
from tests.test_suppression import SCHEMA, boxes, iou

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_no_rows(spark):
    """One shuffle deals boxes of both kinds; no pair of them is joined, sorted or aggregated."""
    dets, gts = spark.createDataFrame(boxes(1, 60), SCHEMA), spark.createDataFrame(truth(51), GT)
    for found in (matching.best_truth(dets, gts), matching.best_truth(dets, gts, method="nms")):
        text = plan(found)
        assert "Join" not in text and "Aggregate" not in text and text.count("Exchange ") == 1


def test_best_and_before(spark):
    dets, gts = boxes(2, 120), truth(52, 30)
    odd = [(None, 900, 0, 0.9, 0.0, 0.0, 1.0, 1.0), (0, 901, 0, 0.5, None, 0.0, 1.0, 1.0), (77, 902, 0, 0.5, 0.0, 0.0, 1.0, 1.0)]
    df, gt = spark.createDataFrame(dets + odd, SCHEMA), spark.createDataFrame([*gts, (None, 99, 0.0, 0.0, 1.0, 1.0), (0, 100, *gts[0][2:])], GT)
    got = {r.det_id: r for r in matching.best_truth(df, gt).collect()}
    assert len(got) == 123 and all(got[i].gt_id is None and got[i].iou is None for i in (900, 901, 902))
    gts = [*gts, (0, 100, *gts[0][2:])]
    seen = {}
    for d in sorted(dets, key=lambda d: (-d[3], d[1])):
        likes = [(iou(d, (0, 0, 0, 0, *g[2:])), -g[1]) for g in gts if g[0] == d[0]]
        top, gt_id = max(likes, default=(0, 0))
        r = got[d[1]]
        if top > 0:
            assert (r.gt_id, r.iou) == (-gt_id, pytest.approx(top)) and r.before == pytest.approx(seen.get((d[0], gt_id), -1.0))
            seen[d[0], gt_id] = max(top, seen.get((d[0], gt_id), -1.0))
        else:
            assert r.gt_id is None


@pytest.mark.parametrize("method", sorted(suppression.LIKE))
def test_suppression_on_the_way(spark, method):
    df, gt = spark.createDataFrame(boxes(5, 150), SCHEMA), spark.createDataFrame(truth(55, 40), GT)
    got, want = matching.best_truth(df, gt, method=method, limit=0.3), matching.best_truth(suppression.suppress(df, method, 0.3), gt)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_pairs_in_slices(monkeypatch):
    r = np.random.default_rng(3)
    box = r.random((60, 4)) * [0.5, 0.5, 1, 1]
    rows, n = np.arange(40, 60), np.array([0, 40, 3, 7] * 5)
    low = np.where(n < 40, 5, 0)
    want = B.most_alike(box, rows, low, n)
    for i, (a, s, m) in enumerate(zip(rows, low, n, strict=True)):
        like = [iou((0, 0, 0, 0, *box[a]), (0, 0, 0, 0, *box[b])) if (box[a, :2] < box[b, 2:]).all() and (box[b, :2] < box[a, 2:]).all() else -1 for b in range(s, s + m)]
        assert want[0][i] == (s + int(np.argmax(like)) if max(like, default=-1) >= 0 else -1)
    monkeypatch.setattr(B, "CACHED", 4)
    assert all(np.array_equal(a, b) for a, b in zip(B.most_alike(box, rows, low, n), want, strict=True))
    owner, values = r.integers(0, 4, 50), r.random(50)
    assert B.largest_before(owner, values).tolist() == [max((values[j] for j in range(i) if owner[j] == owner[i]), default=-1.0) for i in range(50)]


def test_only_wanted_rows_are_written(spark, monkeypatch):
    """All rows count, those that are wanted and the last of each group in a range are written, and nothing shuffles them again."""
    out, real = [], prefix.ranged
    monkeypatch.setattr(prefix, "ranged", lambda *a: out.append(real(*a)) or out[-1])
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("at"), (F.col("id") % 100 == 0).alias("hit"))
    got = prefix.running(df, ["at"], {"seen": F.lit(1), "hits": F.col("hit")}, ("g",), 7, F.col("hit"), ["g", "at"])
    assert out[0].count() <= 50 + 2 * 7 + 3 and "Exchange hashpartitioning(_task" not in plan(got)
    rows = sorted((r.g, r.at, r.hit) for r in df.collect())
    want, seen, hits, last = [], 0, 0, None
    for g, at, hit in rows:
        seen, hits, last = (seen + 1, hits + hit, g) if g == last else (1, int(hit), g)
        want += [(g, at, seen, hits)] * hit
    assert sorted(map(tuple, got.collect())) == want


def test_lines_are_dealt_once(spark):
    """Detections and annotations share one shuffle of the lines, and boxes that are dealt by image stay where they are."""
    own = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what is reused
    try:
        text = plan(matching.best_truth(X.detections(spark, SMOKE), X.truths(spark, SMOKE), ("fold", "image_id"), "nms"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", own)
    assert text.count("- Exchange ") == 2 and text.count("ReusedExchange ") == 2  # of lines and images
