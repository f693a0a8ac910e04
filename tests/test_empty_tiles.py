import math

import duckdb

import __spark_entry__
from gridloom.plans import catalogue
from gridloom.plans.fixture import sql

DATA = "/root/testdata/sf0.001"


def test_sample_follows_annotated(spark):
    db = duckdb.connect()
    for name in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    tiles, empty, images = db.execute(sql(catalogue._EMPTY + " SELECT (SELECT count(*) FROM tl), (SELECT count(*) FROM e), (SELECT count(*) FROM img)")).fetchone()
    got = sorted(r.tile_id for r in __spark_entry__.queries()["empty_tile_sample_full"](spark, DATA).collect())
    assert len(got) == min(empty, math.ceil((tiles - empty + images) * 0.08)) != 80
    assert got == sorted(r[0] for r in db.execute(__spark_entry__.oracle_sql()["empty_tile_sample_full"]).fetchall())


def test_no_table_of_tiles_is_broadcast(spark):
    """Its size is that of the images' file to the planner, whatever number of tiles images have."""
    for part in catalogue._used_and_empty(spark, DATA):
        assert "BroadcastExchange" not in part._jdf.queryExecution().executedPlan().toString()
