import numpy as np
import pytest

from gridloom.operators import matching as M
from gridloom.operators import metrics as E
from gridloom.operators import sweep as W
from tests.test_suppression import SCHEMA, boxes, iou

GT = "image_id long, gt_id long, x1 double, y1 double, x2 double, y2 double"


def truth(seed, n=25):
    return [(r[0], i, *r[4:]) for i, r in enumerate(boxes(seed, n))]


def loop(dets, gts, thr):
    """Matching detection by detection in falling score."""
    out = {}
    for image in {d[0] for d in dets}:
        own, used = [g for g in gts if g[0] == image], set()
        for d in sorted((d for d in dets if d[0] == image), key=lambda d: (-d[3], d[1])):
            likes = [iou(d, (0, 0, 0, 0, *g[2:])) for g in own]
            best = int(np.argmax(likes)) if likes else -1
            out[d[1]] = bool(likes) and likes[best] >= thr and own[best][1] not in used
            if out[d[1]]:
                used.add(own[best][1])
    return out


def ap(dets, gts, thr):
    hit = loop(dets, gts, thr)
    order = sorted(dets, key=lambda d: (-d[3], d[0], d[1]))
    tp = np.cumsum([hit[d[1]] for d in order])
    precision, recall = tp / (np.arange(len(order)) + 1 + 1e-9), tp / len(gts)
    return np.mean([max(precision[recall >= t], default=0) for t in np.linspace(0, 1, 101)])


@pytest.mark.parametrize("seed", range(3))
def test_against_the_loop(spark, seed):
    dets, gts = boxes(seed, 60), truth(seed + 50)
    df, gt = spark.createDataFrame(dets, SCHEMA), spark.createDataFrame(gts, GT)
    assert {r.det_id: r.is_tp for r in M.match(df, gt, 0.3).collect()} == loop(dets, gts, 0.3)
    n = spark.createDataFrame([(len(gts),)], "n_gt long")
    for r in E.average_precision(M.best_truth(df, gt), n).collect():
        assert abs(r.ap - ap(dets, gts, r.iou_threshold)) < 1e-9


def test_thresholds_are_the_float_artefacts():
    assert E.IOU_THRESHOLDS[5] == 0.7500000000000002


def test_perfect_and_none(spark):
    gts = truth(3)
    dets = [(g[0], g[1], 0, 0.9, *g[2:]) for g in gts]
    gt = spark.createDataFrame(gts, GT)
    assert E.evaluate(spark.createDataFrame(dets, SCHEMA), gt).first().map > 0.99
    assert E.evaluate(spark.createDataFrame([], SCHEMA), gt).first().map == 0


def test_empty_images_count(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    dets, gt = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 1.0, 1.0)], SCHEMA), spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0)], GT)
    rows = {r.image_id: r for r in M.counting(images, gt, dets, M.match(dets, gt)).collect()}
    assert (rows[1].tp, rows[2].tp, rows[2].predicted, rows[2].fn) == (1, 0, 0, 0)


@pytest.mark.parametrize("pairs,want", [([(10, 8), (0, 3)], (2.5, None)), ([(5, 5), (5, 7), (5, 6)], (1.0, 0.0)), ([(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)], (2.4, -1.0)), ([(1, 3), (2, 3)], (1.5, None)), ([(4, 4)], (0.0, 0.0))])
def test_counting_errors(spark, pairs, want):
    row = E.counting_errors(spark.createDataFrame(pairs, "groundtruth long, predicted long")).first()
    assert abs(row.mae - want[0]) < 1e-12
    if want[1] is not None:
        assert abs(row.pearson_r - want[1]) < 1e-9
    elif len({p for _, p in pairs}) == 1:
        assert row.pearson_r is None


def test_zero_area_pairs_do_not_match(spark):
    dets, gt = spark.createDataFrame([(1, 0, 0, 0.9, 0.5, 0.5, 0.5, 0.5)], SCHEMA), spark.createDataFrame([(1, 0, 0.5, 0.5, 0.5, 0.5)], GT)
    assert [r.is_tp for r in M.match(dets, gt).collect()] == [False]


@pytest.mark.parametrize("method", ["nms", "cluster_diou_nms", "nms_ioa"])
def test_sweep_filters_before_it_suppresses(spark, method):
    from gridloom.operators.suppression import suppress

    df, steps = spark.createDataFrame(boxes(4, 80), SCHEMA), [0.2, 0.5, 0.7]
    got = {(r.threshold, r.det_id) for r in W.at_thresholds(df, steps, method).select("threshold", "det_id").collect()}
    assert got == {(t, r.det_id) for t in steps for r in suppress(df.filter(df.score >= t), method, 0.5).collect()}


def test_best_threshold_takes_the_lowest_of_equals(spark):
    df = spark.createDataFrame([(0.3, 0.8), (0.2, 0.8), (0.1, 0.5)], "threshold double, fscore double")
    assert W.best_threshold(df).first().threshold == 0.2
    assert W.nearest_threshold(df, 0.25).first().threshold == 0.2
    assert len(W.CUBE) == 45 and W.CUBE[-1] == 0.98 and len(W.SCATTER) == 18 and len(W.VALIDATION) == 15


def test_cube_and_scatter(spark):
    import json

    rows = spark.createDataFrame([("a", 0, 0.1, 0.5, 0.5, 0.5, 0.5, 1.0)], "arch string, fold int, threshold double, map50 double, precision double, recall double, fscore double, mae double")
    assert json.loads(W.cube(rows, ("arch",)).first().metrics) == {"0.10": {"0": [0.5, 0.5, 0.5, 0.5, 1.0]}}
    images = spark.createDataFrame([(0, 1), (0, 2)], "fold int, image_id long")
    kept = spark.createDataFrame([(0, 1, 0.1)], "fold int, image_id long, threshold double")
    got = {r.image_id: (r.gt, r.pred) for r in W.scatter(images, kept, images.filter("image_id = 2"), [0.1, 0.2]).collect()}
    assert got == {1: (0, {0.1: 1, 0.2: 0}), 2: (1, {0.1: 0, 0.2: 0})}
    one = W.summary(rows).first()
    assert one.map50_std is None and W.displayed(rows).first().map50_std == 0
