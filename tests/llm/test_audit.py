import random
import re
from itertools import permutations

import numpy as np
import pytest

from gridloom.llm import audit

SCHEMA = "doc_id long, text string, source string, part int, key string"


def brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q if k == 0 else t) == 1} for k in (0, 1))
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    rows = []
    for i, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in low and (i is None or i > low[t])}
        rows.append((p or "", {f for f in "ABCDE" if fails[f]}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, lines = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(here)
                lines.append((part, "".join(order), step, len(left), len(here), sum(f in r[1] for r in own) - len(here), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def run(spark, docs, labels):
    got = audit.filter_audit(spark.createDataFrame([(*d, 1, "k") for d in docs], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(map(tuple, got.select(*COLUMNS).collect()))


def test_every_order(spark, texts):
    r = random.Random(3)
    docs = [(i, t + r.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"]), r.choice(["a", "a", "b", None, ""])) for i, t in enumerate(texts)]
    docs += [(200 + i, docs[i][1], "c") for i in range(20)]
    docs += [(300, None, "a"), (301, "", "b"), (None, "", "a"), (None, "only this", "a"), (5, docs[5][1], "a"), (302, "é" * 40_000 + " #", "long"), (303, " ".join(map(str, range(30_000))), "long")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 60, 2), 2, 4, 999, None]]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_part_without_failures(spark):
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "clean") for i in range(5)]
    got = run(spark, docs, [])
    assert got == brute(docs, []) and len(got) == 600 and all(x[3] == 5 and x[4:] == (0,) * 6 for x in got)


def test_empty(spark):
    assert run(spark, [], [(1, 1, 1)]) == []


@pytest.mark.parametrize("seed", range(20))
def test_galloping(seed):
    r = np.random.default_rng(seed)
    lists = [np.unique(r.integers(0, 10 ** r.integers(1, 6), r.integers(0, 3000))) for _ in range(4)]
    ids = np.unique(r.integers(0, 10 ** r.integers(1, 6), r.integers(0, 3000)))
    for other in lists:
        assert (audit.seek(ids, other) == (np.searchsorted(other, ids) if len(other) else 0)).all()
    assert audit.difference(ids, lists).tolist() == sorted(set(ids.tolist()) - {x for y in lists for x in y.tolist()})


def test_sizes_of_overlapping_lists():
    r = np.random.default_rng(1)
    lists, mark = [np.unique(r.integers(0, 500, n)) for n in (300, 20, 0)], np.arange(0, 500, 3)
    for before, f, fails, gone, removed, marked in audit.sizes(lists, [mark]):
        earlier = {x for g in range(3) if before >> g & 1 for x in lists[g].tolist()}
        own = set(lists[f].tolist()) - earlier
        assert (fails, gone, removed, marked) == (len(lists[f]), len(earlier), len(own), len(own & set(mark.tolist())))
