import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import splits
from gridloom.sources import cache, readers

NAMES = [c.split(" ")[0] for c in readers.DETECTION.split(", ")]


def engine(todo):
    """Two detections in each image, none in every fifth."""
    rows = todo.withColumn("k", F.explode(F.when(F.crc32("image") % 5 == 0, F.array()).otherwise(F.array(F.lit(1), F.lit(2))).cast("array<int>")))
    return rows.select("split", "arch", "dataset", "fold", "image", (F.crc32("image") * 10 + F.col("k")).alias("det_id"), F.lit(0).alias("label"), F.lit(0.5).alias("score"), *[F.lit(float(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def test_runs_that_die_or_repeat(spark, tmp_path):
    wanted = spark.range(60).select(F.lit("val").alias("split"), F.lit("a").alias("arch"), F.lit("d").alias("dataset"), (F.col("id") % 3).cast("int").alias("fold"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("image"))
    path, seen = str(tmp_path / "cache"), []

    def counted(todo):
        seen.append(todo.count())
        return engine(todo)

    def dying(todo):
        return engine(todo).withColumn("score", F.when(F.col("image") == "i50", F.raise_error(F.lit("died"))).otherwise(F.col("score")).cast("double"))

    assert cache.detections(spark, path).count() == 0
    cache.collect(wanted.filter("fold = 1"), path, counted)
    with pytest.raises(Exception, match="died"):
        cache.collect(wanted, path, dying)
    got = cache.collect(wanted, path, counted)
    assert got.columns == NAMES and sorted(map(tuple, got.collect())) == sorted(map(tuple, engine(wanted).select(*NAMES).collect()))
    assert cache.collect(wanted, path, counted).count() == got.count() and seen == [20, 40]  # images without detections are done too
    todo = cache.missing(wanted, path)
    assert todo.count() == 0
    # Two runs that did the same images at once: one of them counts.
    name = next(p.name for p in (tmp_path / "cache" / "log").iterdir() if p.name.startswith("run="))
    for part, by in (("log", []), ("data", ["split", "arch", "dataset", "fold"])):
        spark.read.parquet(f"{path}/{part}/{name}").write.partitionBy(*by).parquet(f"{path}/{part}/run=zz")
    assert cache.detections(spark, path).count() == got.count()
    assert cache.tidy(spark, path) >= 1 and cache.tidy(spark, path) == 0 and cache.detections(spark, path).count() == got.count()


def test_shares_are_those_of_the_loop():
    r = random.Random(2)
    for _ in range(1000):
        folds, sizes = r.randint(1, 7), {g: r.choice([1, 1, 2, 3, r.randint(1, 40)]) for g in range(r.randint(1, 60))}
        want, load = splits.group_folds(sizes, folds), [0] * folds
        for size in sorted(set(sizes.values()), reverse=True):
            own = [g for g in sizes if sizes[g] == size]
            got = splits.shares(load, size, len(own))
            assert got == [sum(want[g] == f for g in own) for f in range(folds)]
            load = [x + n * size for x, n in zip(load, got, strict=True)]


@pytest.mark.parametrize("folds", [1, 3, 5])
def test_groups_in_their_folds(spark, folds):
    r = random.Random(folds)
    rows = [(i, r.choice([None, *range(30), *range(8)])) for i in range(400)] + [(1000 + i, 100 + i) for i in range(50)]
    sizes = {}
    for _, g in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0)):
        sizes[g] = sizes.get(g, 0) + 1
    want = splits.group_folds(sizes, folds)
    got = splits.group_kfold(spark.createDataFrame(rows, "image_id long, grp long"), "grp", folds)
    assert sorted((x.image_id, x.test_fold) for x in got.collect()) == sorted((i, want[g]) for i, g in rows)


def test_many_groups(spark):
    got = splits.group_kfold(spark.range(300_000).withColumn("grp", F.col("id") % 200_000), "grp", 4)
    load = {x.test_fold: x["count"] for x in got.groupBy("test_fold").count().collect()}
    assert len(load) == 4 and max(load.values()) - min(load.values()) <= 2
    assert got.groupBy("grp").agg(F.countDistinct("test_fold").alias("n")).filter("n > 1").count() == 0
