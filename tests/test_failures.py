import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import service
from gridloom.operators import failures, tiling


def engine(bad=()):
    def load():
        def predict(pdf):
            if set(pdf["id"]) & set(bad):
                raise KeyError(f"row {min(set(pdf['id']) & set(bad))}")
            hit = pdf[pdf["id"] % 3 != 0]
            return pd.DataFrame({"id": hit["id"], "twice": 2 * hit["id"]})

        return predict

    return load


@pytest.mark.parametrize("bad", [(), (0,), (5, 6, 7, 99), tuple(range(100))])
def test_each_failure_is_a_row(spark, bad):
    rows = spark.range(100).withColumn("part", F.col("id") % 4)
    out = failures.captured(rows, engine(bad), "id long, twice long", ("id", "part"))
    good = [i for i in range(100) if i not in bad]
    assert sorted(map(tuple, out.results.collect())) == [(i, 2 * i) for i in good if i % 3]
    assert sorted(map(tuple, out.failures.collect())) == [(i, i % 4, f"KeyError: 'row {i}'") for i in sorted(bad)]
    assert sorted(r.id for r in out.done.collect()) == good
    assert out.counts == {"done": len(good), "failed": len(bad), "results": sum(i % 3 > 0 for i in good)}
    if good:
        assert out.checked() is out
    else:
        with pytest.raises(RuntimeError):
            out.checked()


def test_a_failed_part_fails_its_group(spark):
    rows = spark.range(40).withColumn("part", F.col("id") % 4)
    found = failures.captured(rows.withColumn("image", F.floor(F.col("id") / 4)), lambda: lambda pdf: engine((9, 11, 30))()(pdf).assign(image=lambda x: x["id"] // 4), "image long, id long, twice long", ("image", "part"))
    out = failures.by_group(found, "image", ("part",))
    assert sorted(map(tuple, out.failures.collect())) == [(2, "KeyError: 'row 9'"), (7, "KeyError: 'row 30'")]
    assert {r.image for r in out.results.collect()} == set(range(10)) - {2, 7} == {r.image for r in out.done.collect()}
    assert out.counts["done"] == 8 and out.counts["failed"] == 2


def test_a_group_ends_at_its_first_failure():
    """Groups are halved; of one that fails only its first row that does is searched for, and others are done once."""
    calls = []

    def picky(p):
        calls.append(len(p))
        if bad := sorted({21, 23, 24, 399} & set(p["a"])):
            raise ValueError(bad[0])
        return p

    frame = pd.DataFrame({"a": range(400)})
    parts = list(failures.halved_by_group(frame, np.arange(0, 400, 10), picky))
    assert [(int(at[0]), str(e)) for at, _, e in parts if e] == [(21, "21"), (399, "399")]
    assert np.concatenate([at for at, _, e in parts if not e]).tolist() == [x for x in range(0, 390, 10) if x != 20]
    assert pd.concat([r for _, r, e in parts if not e])["a"].tolist() == [x for x in range(390) if not 20 <= x < 30] and len(calls) < 35
    alone = lambda p: p if len(p) < 3 else (_ for _ in ()).throw(ValueError("too many"))
    parts = list(failures.halved_by_group(frame[:9], np.array([0, 4, 5]), alone))  # a group whose rows fail together only
    assert [at.tolist() for at, _, _ in parts] == [[0], [], [4], [5], []] and pd.concat([r for _, r, _ in parts])["a"].tolist() == list(range(9)) and not any(e for _, _, e in parts)


def test_groups_over_batches(spark):
    """Rows of a group in several batches, in any order: the first part that fails is the group's, and nothing of the group is left."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(60).selectExpr("id", "id % 6 AS image", "5 + id % 11 AS part").orderBy(F.rand(3)).coalesce(1)
        load = lambda: lambda pdf: engine((8, 20, 32, 45))()(pdf).assign(image=lambda x: x["id"] % 6)
        found = failures.captured(rows, load, "image long, id long, twice long", ("image", "part", "id"), "image", ("part", "id"))
        out = failures.by_group(found, "image", ("part", "id"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, out.failures.collect())) == [(2, f"KeyError: 'row {min((8, 20, 32), key=lambda i: i % 11)}'"), (3, "KeyError: 'row 45'")]
    good = [i for i in range(60) if i % 6 not in (2, 3)]
    assert sorted(r.id for r in out.results.collect()) == [i for i in good if i % 3] and sorted(r.image for r in out.done.collect()) == [0, 1, 4, 5]
    assert out.counts == {"done": 4, "failed": 2, "results": sum(i % 3 > 0 for i in good)}


def test_empty(spark):
    out = failures.captured(spark.range(0), engine(), "id long, twice long", ("id",))
    assert out.results.collect() == out.failures.collect() == out.done.collect() == [] and out.checked().counts["done"] == 0


def test_one_call_a_batch_where_nothing_fails():
    calls = []
    parts = list(failures.halved(pd.DataFrame({"a": range(64)}), lambda p: calls.append(len(p)) or p))
    assert calls == [64] and len(parts) == 1

    def picky(p):
        calls.append(len(p))
        if 37 in set(p["a"]):
            raise ValueError
        return p

    calls.clear()
    parts = list(failures.halved(pd.DataFrame({"a": range(64)}), picky))
    assert len(calls) == 13 and pd.concat([p for p, _, _ in parts])["a"].tolist() == list(range(64))


def test_requests(spark):
    images = spark.createDataFrame([(i, f"{i}.jpg", 1300, 700) for i in range(6)], "image_id long, file_name string, width int, height int")

    def load():
        def predict(pdf):
            if (pdf["image_id"] == 4).any():
                raise OSError("unreadable")
            return pdf[["image_id"]].assign(tile_x=pdf["x"], tile_y=pdf["y"], label=0, score=0.9, x1=1.0, y1=1.0, x2=50.0, y2=50.0)

        return predict

    final, summary, failed = service.infer_dataset_captured(images, tiling.Tiling("sahi"), load, method="nms")
    assert {r.image_id for r in final.collect()} == {r.image_id for r in summary.collect()} == {0, 1, 2, 3, 5}
    assert [tuple(r) for r in failed.collect()] == [(4, "OSError: unreadable")]

    def stream(frames):
        predict = load()
        for pdf in frames:
            yield predict(pdf)

    final, summary = service.infer_image(images, tiling.Tiling("asahi"), stream, "3.jpg", method="nms")
    assert {r.image_id for r in final.collect()} == {3} and summary.count() == 1
    assert service.choose_image(images).count() == 1
    for name in ("9.jpg", "a/3.jpg"):
        with pytest.raises(ValueError, match="no image"):
            service.choose_image(images, name)
