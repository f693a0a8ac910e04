from collections import Counter

import numpy as np
import pytest

from gridloom.llm import substring
from gridloom.llm.windows import Finder


def brute(rows, n):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[p : p + n]) for _, w in words for p in range(len(w) - n + 1))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - n + 1):
            if seen[tuple(w[p : p + n])] > 1:
                gone[p : p + n] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("finder", [None, dict(n=12, k=4, sample=1, common=3, batch=2000), dict(n=12, k=4, batch=500, places=5), dict(n=4, k=2, batch=900)])
def test_words(make, texts, finder):
    rows = [*enumerate(texts), (100, None), (101, "ab " * 400), (5, texts[5]), (None, texts[9]), (102, "x y z " * 30 + "\x0b\x1c w"), (103, " ".join(texts[17].split()[100:400]))]
    got = substring.drop_repeats(make(rows), finder=Finder(words=True, every=True, **finder) if finder else None).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, (finder or {"n": 35})["n"])


def test_wavelet_and_matching():
    r = np.random.default_rng(5)
    values = r.integers(0, 37, 500)
    own = substring.Wavelet(values, 37)
    symbol, place = r.integers(0, 37, 300), r.integers(0, 501, 300)
    assert own.rank(symbol, place).tolist() == [int((values[:p] == s).sum()) for s, p in zip(symbol, place, strict=True)]
    documents = [[b"%d" % x for x in r.integers(0, 4, 50)] for _ in range(6)]
    index = substring.FMIndex(documents)
    for d in range(6):
        for end in range(1, 51):
            got = index.matching(index.sequence, np.array([end]), np.array([51 * d + end]), 2, 20)[0]
            count = lambda k: sum(x[q : q + k] == documents[d][end - k : end] for x in documents for q in range(51 - k))  # noqa: B023, E731
            want = max((k for k in range(1, min(end, 20) + 1) if count(k) >= 2), default=0)
            assert got == want


def test_empty(make):
    assert substring.drop_repeats(make([])).collect() == []
