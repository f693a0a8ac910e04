import json

import duckdb
import pytest

import __spark_entry__
from gridloom.operators import sweep
from gridloom.plans import catalogue
from gridloom.plans.fixture import sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for name in ("part", "lineitem"):
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return out


@pytest.mark.parametrize("name,grid", [("sweep_curve_full", sweep.VALIDATION), ("scatter_counts_full", sweep.SCATTER)])
def test_full_grids(spark, db, name, grid):
    rows = __spark_entry__.queries()[name](spark, DATA).collect()
    assert sorted({r.threshold for r in rows}) == grid
    assert sorted(map(tuple, rows)) == sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_full_cube(spark, db):
    (row,) = __spark_entry__.queries()["threshold_cube_full"](spark, DATA).collect()
    cube = json.loads(row.metrics)
    assert list(cube) == [f"{t:.2f}" for t in sweep.CUBE]
    for threshold, fold, *values in db.execute(sql(catalogue.sweep_sql(sweep.CUBE) + " SELECT threshold, fold, map50, precision, recall, fscore, mae FROM fm")).fetchall():
        assert cube[f"{threshold:.2f}"][str(fold)] == pytest.approx(values, abs=6e-4)
