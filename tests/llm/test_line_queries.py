import duckdb

import __spark_entry__
from gridloom.llm import lines
from tests.llm.test_lines import brute

LONE = "This line stands in each text, between other neighbours each time."


def test_lone_lines(spark, make, tmp_path):
    """Repeated lines with different neighbours, and texts of one line, in the query, its SQL and brute force."""
    rows = [(1, f"a\n{LONE}\nb"), (2, f"c\n\n{LONE}\nd"), (3, LONE), (4, LONE), (5, "own line"), (6, "a\nb\na"), (7, None), (8, "\n  \n  ")]
    docs = make(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["op5_every_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 3, 7: 0, 8: 0}
    kept = lines.drop_repeated_runs(docs, run=1).collect()
    assert sorted(map(tuple, kept), key=str) == brute(rows, 1)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(__spark_entry__.oracle_sql()["op5_every_line_dedup"]).fetchall())
