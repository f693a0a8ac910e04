import numpy as np
import pytest

from gridloom.operators import suppression as S

SCHEMA = "image_id long, det_id long, label int, score double, x1 double, y1 double, x2 double, y2 double"


def boxes(seed, n=40, images=3):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, y, w, h = map(float, r.uniform(0, 0.5, 4))
        out.append((int(r.integers(images)), i, int(r.integers(2)), float(r.integers(1, 12)) / 12, x, y, x + w + 0.05, y + h + 0.05))
    return out


def iou(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    both = max(w, 0) * max(h, 0)
    return both / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - both)


def diou(a, b, least=0.0, eps=1e-7):
    w, h = max(min(a[6], b[6]) - max(a[4], b[4]), 0), max(min(a[7], b[7]) - max(a[5], b[5]), 0)
    union = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h
    d = ((a[4] + a[6] - b[4] - b[6]) / 2) ** 2 + ((a[5] + a[7] - b[5] - b[7]) / 2) ** 2
    c = (max(a[6], b[6]) - min(a[4], b[4])) ** 2 + (max(a[7], b[7]) - min(a[5], b[5])) ** 2
    return w * h / (union + eps) - d / max(c + eps, least)


def groups(rows, by):
    out = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        out.setdefault(by(r), []).append(r)
    return out.values()


def greedy(rows, by, like, cut):
    kept = []
    for g in groups(rows, by):
        own = []
        for r in g:
            if not any(like(k, r) > cut for k in own):
                own.append(r)
        kept += own
    return {r[1] for r in kept}


@pytest.mark.parametrize("seed", range(4))
def test_greedy(spark, seed):
    rows = boxes(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.det_id for r in S.nms(df).collect()} == greedy(rows, lambda r: (r[0], r[2]), iou, 0.5)
    assert {r.det_id for r in S.cluster_diou_nms(df, 0.3).collect()} == greedy(rows, lambda r: r[0], diou, 0.3)


def test_cluster_fixed_point(spark):
    """The matrix iteration (keep what no kept better box suppresses, until nothing changes) ends where the greedy fold does."""
    rows = boxes(9, 30, 1)
    order = sorted(rows, key=lambda r: (-r[3], r[1]))
    like = np.array([[diou(a, b) for b in order] for a in order])
    keep = np.ones(len(order), bool)
    while True:
        new = np.array([not any(keep[i] and like[i, j] > 0.4 for i in range(j)) for j in range(len(order))])
        if (new == keep).all():
            break
        keep = new
    got = {r.det_id for r in S.cluster_diou_nms(spark.createDataFrame(rows, SCHEMA), 0.4).collect()}
    assert got == {r[1] for r, k in zip(order, keep, strict=True) if k}


@pytest.mark.parametrize("seed", range(3))
def test_adaptive(spark, seed):
    rows, want = boxes(seed), set()
    for g in groups(rows, lambda r: (r[0], r[2])):
        left = list(g)
        while left:
            best, left = left[0], left[1:]
            want.add(best[1])
            if left:
                like = [diou(best, o, 1e-6, 0.0) for o in left]
                cut = max(0.3, 0.5 - 0.1 * np.mean(sorted(like)[::-1][:5]))
                left = [o for o, v in zip(left, like, strict=True) if not (v > cut or (v > 0.7 and o[3] / best[3] >= 0.5))]
    assert {r.det_id for r in S.adaptive_nms(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_fusion(spark):
    make = lambda *rows: spark.createDataFrame([(1, i, lab, s, *map(float, b)) for i, (lab, s, b) in enumerate(rows)], SCHEMA)
    fuse = lambda *rows: S.wbf(make(*rows)).collect()
    (one,) = fuse((0, 0.9, (0.1, 0.1, 0.5, 0.5)))
    assert (one.x1, one.x2, one.score) == (0.1, 0.5, 0.9)
    (two,) = fuse((0, 0.9, (0.1, 0.1, 0.6, 0.6)), (0, 0.9, (0.2, 0.2, 0.7, 0.7)))
    assert 0.1 < two.x1 < 0.2 and 0.6 < two.x2 < 0.7
    assert len(fuse((0, 0.9, (0, 0, 0.3, 0.3)), (0, 0.8, (0.5, 0.5, 0.8, 0.8)))) == 2
    assert {r.label for r in fuse((0, 0.9, (0.1, 0.1, 0.5, 0.5)), (1, 0.8, (0.1, 0.1, 0.5, 0.5)))} == {0, 1}
    assert len(fuse((0, 0.9, (0.1, 0.1, 0.5, 0.5)), (0, 0.0005, (0.6, 0.6, 0.9, 0.9)))) == 1


def test_box_weighting(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 0.4, 0.4), (1, 1, 0, 0.3, 0.1, 0.0, 0.5, 0.4), (1, 2, 0, 0.5, 0.6, 0.6, 0.9, 0.9)], SCHEMA)
    got = {r.det_id: r for r in S.bws(df).collect()}
    assert set(got) == {0, 2} and abs(got[0].x1 - 0.025) < 1e-12 and got[0].score == 0.9


def test_ties_edges_and_empty(spark):
    df = spark.createDataFrame([(1, 5, 0, 0.5, 0.0, 0.0, 1.0, 1.0), (1, 3, 0, 0.5, 0.0, 0.0, 1.0, 1.0), (1, 7, 0, 0.4, 0.0, 0.0, 0.0, 0.0), (1, 8, 0, 0.3, 0.0, 0.0, 0.0, 0.0)], SCHEMA)
    assert {r.det_id for r in S.nms(df).collect()} == {3, 7, 8}
    exact = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 2.0, 1.0), (1, 1, 0, 0.8, 0.0, 0.0, 1.0, 1.0)], SCHEMA)
    assert S.nms(exact, 0.5).count() == 2  # an IoU equal to the threshold stays
    none = spark.createDataFrame([], SCHEMA)
    for m in S.METHODS:
        assert S.suppress(none, m, 0.5).count() == 0
    with pytest.raises(ValueError):
        S.suppress(none, "other", 0.5)
