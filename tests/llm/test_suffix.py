import numpy as np
import pytest

from gridloom.llm import suffix
from gridloom.llm.windows import Finder


def brute(rows, n=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] if rows[i][0] is not None else 0))
    seen, out = set(), []
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if (s := t[p : p + n]) in seen:
                gone[p : p + n] = True
            seen.add(s)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((rows[i][0], len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=str)


@pytest.mark.parametrize("finder", [None, dict(n=40, k=12, sample=1, common=3, batch=2000), dict(n=40, k=12, batch=500, places=5), dict(n=9, k=2, batch=900)])
def test_bytes(make, texts, finder):
    rows = [*enumerate(texts), (100, None), (101, "ab" * 400), (102, "abc" + "ab" * 100), (103, texts[17])]
    if not finder:
        rows += [(5, texts[5]), (None, texts[9]), (None, texts[11])]
    n = (finder or {"n": 100})["n"]
    got = suffix.drop_repeats(make(rows), finder=Finder(words=False, every=False, **finder) if finder else None).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, n)


def test_collisions_are_found():
    r = np.random.default_rng(2)
    blocks = [r.integers(97, 100, 60).astype(np.uint8).tobytes() for _ in range(40)] + [b"abc" * 20] * 3
    gram, key, start = np.sort(r.integers(0, 3, len(blocks))), r.permutation(len(blocks)), np.zeros(len(blocks), np.int64)
    want = suffix.repeats(blocks, gram, key, start, start, 7)
    bad = suffix.repeats(blocks, gram, key, start, start, 7, tokens=lambda t: np.zeros(len(t), np.uint64))
    assert sorted(zip(*map(np.ndarray.tolist, want), strict=True)) == sorted(zip(*map(np.ndarray.tolist, bad), strict=True))


def test_empty(make):
    assert suffix.drop_repeats(make([])).collect() == []
