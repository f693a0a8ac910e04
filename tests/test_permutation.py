import pytest
from pyspark.sql import functions as F

from gridloom.operators import splits


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 100, 1000, 4097, 10_000])
def test_a_bijection(spark, n):
    rows = spark.range(n).select("id", splits.permuted(F.col("id"), n, 7).alias("a"), splits.permuted(F.col("id"), n, 8).alias("b")).collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n))
    if n >= 100:
        assert [r.a for r in rows] != [r.b for r in rows]
        assert sum(abs(r.a - r.id) < n / 10 for r in rows) < 0.4 * n


def test_folds_have_the_sizes_of_the_hashed_ones(spark):
    images = spark.range(103).withColumnRenamed("id", "image_id")
    sizes = lambda df: {(r.split_fold, r.split): r["count"] for r in df.groupBy("split_fold", "split").count().collect()}
    assert sizes(splits.kfold_permuted(images)) == sizes(splits.kfold_holdout(images))
    assert splits.kfold_permuted(images).filter("split = 'test'").select("image_id").distinct().count() == 103
