import pytest

from gridloom.functions import prefix
from gridloom.operators import matching, metrics, suppression, sweep
from tests.test_metrics import GT, truth
from tests.test_suppression import SCHEMA, boxes


@pytest.fixture
def ranged(monkeypatch):
    """Rows of each table that is written in ranges."""
    out, real = [], prefix.ranged
    monkeypatch.setattr(prefix, "ranged", lambda df, *more: out.append(df.count()) or real(df, *more))
    return out


def test_thresholds_do_not_multiply_what_is_written(spark, ranged):
    dets = spark.createDataFrame([(r[0] % 2, *r) for r in boxes(2, 60)], "fold long, " + SCHEMA)
    gts = spark.createDataFrame([(r[0] % 2, *r) for r in truth(52)], "fold long, " + GT)
    images = spark.createDataFrame([(i % 2, i) for i in range(4)], "fold long, image_id long")
    steps = [0.1 * i for i in range(2, 9)]
    got = {(r.threshold, r.fold): r for r in sweep.fold_metrics(images, dets, gts, steps).collect()}
    assert ranged == [suppression.nms(dets.filter(f"score >= {steps[0]!r}"), keys=("fold", "image_id")).count()]
    for t in steps:
        for r in sweep.fold_metrics(images, dets, gts, [t]).collect():
            assert tuple(r) == pytest.approx(tuple(got[t, r.fold]))
    assert len(got) == 2 * len(steps)


def test_one_order_for_all_iou_thresholds(spark, ranged):
    dets, gts = spark.createDataFrame(boxes(1, 60), SCHEMA), spark.createDataFrame(truth(51), GT)
    assert metrics.average_precision(matching.best_truth(dets, gts), spark.createDataFrame([(25,)], "n_gt long")).count() == 10
    assert ranged == [60]
