import hashlib
import re
from collections import defaultdict

import pytest

from gridloom.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    low = {t: min((i for i in v if i is not None), default=None) for t, v in groups.items()}
    out = []
    for i, t in rows:
        t = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        out.append((i, low[t], len(groups[t]), i == low[t], hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_groups(make, texts, limit):
    rows = [*enumerate(texts), (100, None), (101, None), (None, "x"), (None, "x"), (7, texts[7]), (None, texts[3]), (102, "a\t\nb"), (103, "a b"), (104, "a b")]
    got = exact.exact_groups(make(rows), broadcast_bytes=limit)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_drop(make, texts, limit):
    rows = [*enumerate(texts), (100, None), (101, ""), (None, "x"), (None, "x"), (7, texts[7])]
    df = make(rows)
    got = exact.drop_exact_duplicates(df, broadcast_bytes=limit)
    assert got.columns == df.columns
    want = {(low, sha) for _, low, _, _, sha in brute(rows)}
    assert sorted(((r.doc_id, hashlib.sha256(exact_text(r.text).encode()).hexdigest()) for r in got.collect()), key=str) == sorted(want, key=str)


def exact_text(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_empty(make):
    assert exact.exact_groups(make([])).collect() == []
    assert exact.drop_exact_duplicates(make([])).collect() == []


def test_unique_rows_do_not_shuffle(spark, make):
    """A filter of many slices: the branch of rows that pass straight through has no exchange of rows, and false alarms are few."""
    rows = [(i, f"text number {i if i >= 10_000 else i // 2}") for i in range(20_000)]
    digests = make(rows).selectExpr("doc_id AS id", "xxhash64(text) AS h", "text AS sha")
    repeats = exact.Repeats(digests, broadcast_bytes=1)
    assert len(repeats.sieve.slices) == repeats.sieve.blocks > 1
    tested = repeats.marked(digests)
    plan = tested.filter("NOT again")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    flagged = {r.id for r in tested.filter("again").collect()}
    assert flagged >= set(range(10_000)) and len(flagged) < 10_000 + 1000
    assert sorted(map(tuple, exact.exact_groups(make(rows), broadcast_bytes=1).collect()), key=str) == brute(rows)
