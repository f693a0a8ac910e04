import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import crowds, labels, suppression, tiling


def detections(spark, n, images=3, seed=0, side=0.02):
    r = np.random.default_rng(seed)
    x, y = r.random(n), r.random(n)
    w, h = side * (0.5 + r.random(n)), side * (0.5 + r.random(n))
    x[: n // 4], y[: n // 4] = 0.5 + 0.01 * r.random(n // 4), 0.5 + 0.01 * r.random(n // 4)  # a dense place
    w[: n // 50] = 0.9  # boxes over many strips
    rows = [(int(i % images), int(i), int(i % 2), round(float(s), 3), *map(float, b)) for i, (s, b) in enumerate(zip(r.random(n), np.stack([x, y, x + w, y + h], 1), strict=True))]
    rows += [(a, i + n, *rest) for a, i, *rest in rows[:20]]  # equal boxes with equal scores
    return spark.createDataFrame(rows, "image_id long, det_id long, label int, score double, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize("crowd", [7, 60, 4096])
def test_equal_to_the_fold(spark, crowd):
    dets = detections(spark, 900)
    for mine, fold in ((crowds.nms, suppression.nms), (crowds.cluster_diou_nms, suppression.cluster_diou_nms)):
        got, want = mine(dets, 0.4, crowd=crowd), fold(dets, 0.4)
        assert got.columns == dets.columns and sorted(r.det_id for r in got.collect()) == sorted(r.det_id for r in want.collect())


@pytest.mark.parametrize("task,crowd", [(40, 7), (150, 30)])
def test_rounds_between_parts(spark, monkeypatch, task, crowd):
    monkeypatch.setattr(crowds, "TASK", task)
    dets = detections(spark, 900, seed=2)
    for mine, fold in ((crowds.nms, suppression.nms), (crowds.cluster_diou_nms, suppression.cluster_diou_nms)):
        assert sorted(map(tuple, mine(dets, 0.3, crowd=crowd).collect())) == sorted(map(tuple, fold(dets, 0.3).collect()))


def test_only_what_is_kept_is_written(spark, monkeypatch):
    """Images that a task may hold are decided in one pass: boxes move once, and no table has those that go."""
    made, real = [], crowds.written
    monkeypatch.setattr(crowds, "written", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    dets = detections(spark, 900)
    got = crowds.nms(dets, 0.4, crowd=7)
    kept = sorted(r.det_id for r in suppression.nms(dets, 0.4).collect())
    assert [name for name, _ in made] == ["extents", "judged"] and sorted(r.det_id for r in made[1][1].collect()) == sorted(r.det_id for r in got.collect()) == kept
    moved, real_map = [], type(dets).mapInArrow
    monkeypatch.setattr(type(dets), "mapInArrow", lambda self, *a: moved.append(self._jdf.queryExecution().executedPlan().toString().count("Exchange ")) or real_map(self, *a))
    again = crowds.nms(dets.repartition(3, "image_id"), 0.4, crowd=7)
    assert moved == [1] and sorted(r.det_id for r in again.collect()) == kept
    assert len(kept) < dets.count() and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_one_crowded_image(spark):
    n = 200_000
    r = np.random.default_rng(3)
    x, y, score = r.random(n), r.random(n), r.random(n)
    box = np.stack([x, y, x + 0.003, y + 0.003], 1)
    import pandas as pd

    dets = spark.createDataFrame(pd.DataFrame({"image_id": 1, "det_id": np.arange(n), "label": 0, "score": score, "x1": box[:, 0], "y1": box[:, 1], "x2": box[:, 2], "y2": box[:, 3]}))
    order, cells, want = np.argsort(-score), {}, []
    for i in order:
        at = (int(x[i] / 0.003), int(y[i] / 0.003))
        near = [k for a in range(-1, 2) for b in range(-1, 2) for k in cells.get((at[0] + a, at[1] + b), ())]
        if not near or not (crowds.iou(box[i], box[near]) > 0.5).any():
            cells.setdefault(at, []).append(i)
            want.append(i)
    got = crowds.nms(dets, 0.5)
    assert sorted(x.det_id for x in got.select("det_id").collect()) == sorted(map(int, want))


def test_empty_groups(spark):
    dets = detections(spark, 50)
    assert crowds.nms(dets.limit(0)).collect() == []
    with pytest.raises(ValueError):
        crowds.nms(dets, -0.1)
    same = dets.withColumns({"x1": F.lit(0.5), "x2": F.lit(0.5)})  # no extent, no area: nothing is alike
    assert crowds.nms(same, crowd=5).count() == dets.count()


@pytest.mark.parametrize("t", [tiling.Tiling("sahi"), tiling.Tiling("sahi", 0.3, (50, 70)), tiling.Tiling("asahi"), tiling.Tiling("asahi_rect"), tiling.Tiling("asahi_rect", 0.4), tiling.Tiling("none")])
def test_arithmetic_tiles(spark, t):
    r = np.random.default_rng(1)
    rows = [(i, i % 40, int(w), int(h), float(a), float(b), float(c), float(d)) for i, (w, h, a, b, c, d) in enumerate(zip(*(r.integers(*x, 800) for x in ((30, 3000), (30, 2500), (-50, 3000), (-50, 2500), (0, 400), (0, 900))), strict=True))]
    rows = [(i, i, *x) for i, _, *x in rows] + [(900, 900, 500, 500, 0.5, 499.5, 0.25, 0.25), (901, 901, 0, 5, 1.0, 1.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "ann_id long, image_id long, width int, height int, x double, y double, w double, h double")
    tiled = tiling.tiles(boxes.select("image_id", "width", "height"), t)
    want, got = labels.tile_boxes(boxes, tiled, 1e-12), labels.boxes_on_tiles(boxes, t, 1e-12)
    assert set(got.columns) == set(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert tiling.touched_tiles(boxes, t).count() <= 1.3 * want.count() + 900
