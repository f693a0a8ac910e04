import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import katz


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


class Brute:
    def __init__(self, texts):
        self.uni, self.bi, self.follow = Counter(), Counter(), defaultdict(set)
        for t in texts:
            for a, b in zip(["<s>", *tokens(t)[:-1]], tokens(t), strict=True):
                self.uni[b] += 1
                self.bi[a, b] += 1
                self.follow[a].add(b)
        self.n, self.d1, self.d2 = sum(self.uni.values()), self.discounts(self.uni), self.discounts(self.bi)

    @staticmethod
    def discounts(counts, k=5):
        n, d = Counter(counts.values()), {}
        a = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        for r in range(1, k + 1):
            x = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if n[r] and a < 1 else 1
            d[r] = x if 0 < x < 1 else 1.0
        return d

    def level(self, counts, d):
        total = sum(counts.values())
        free = sum(c * (1 - d.get(c, 1)) for c in counts.values())
        over = total if free > 0 else total + 1
        return {w: c * d.get(c, 1) / over for w, c in counts.items()}, (free if free > 0 else 1) / over

    def word(self, w):
        p, free = self.level(self.uni, self.d1)
        return p.get(w, free)

    def given(self, a, w):
        if a not in self.follow:
            return self.word(w)
        p, free = self.level({b: self.bi[a, b] for b in self.follow[a]}, self.d2)
        return p[w] if w in p else free / (1 - sum(self.word(b) for b in p)) * self.word(w)


@pytest.mark.parametrize("sizes", [{}, dict(word_bits=4, pair_bits=4, gather=300, part=400), dict(word_bits=1, pair_bits=1, gather=50, part=5000)])
def test_scores(make, texts, sizes):
    rows = [*enumerate(texts), (100, None), (101, "never heard Of"), (5, texts[5]), (None, texts[9])]
    rows = [(i, t and " ".join(t.split()[:150])) for i, t in rows]
    brute = Brute([t for i, t in rows if not held(i)])
    words = {w: brute.word(w) for w in {None, *(x for _, t in rows for x in tokens(t))}}
    brute.word = lambda w: words[w]
    known = {}
    want = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((brute.uni[w] + 1) / (brute.n + len(brute.uni) + 1)) for w in own)
        s = 0
        for a, b in zip(["<s>", *own[:-1]], own, strict=True):
            if (a, b) not in known:
                known[a, b] = math.log10(brute.given(a, b))
            s += known[a, b]
        want.append((i, held(i), len(own), sum(brute.uni[w] > 0 for w in own), brute.n, base, s))
    got = katz.language_model_scores(make(rows), **sizes).collect()
    order = lambda r: (str(r[0]), r[2], r[6])
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-9)


def test_distributions_sum_to_one():
    brute = Brute(["a b a b c", "a a a b", "c d e f g a b", "a b"] * 3 + ["x y z", "x x y"])
    vocabulary = [*brute.uni, "?"]
    for a in [*brute.follow]:
        assert abs(sum(brute.given(a, w) for w in vocabulary) - 1) < 1e-9


def test_empty(make):
    assert katz.language_model_scores(make([])).collect() == []


def test_counts_beyond_four_bytes():
    for counts in ([], [1, 2], [1, 1 << 32], [(1 << 62) + 1]):
        n = np.array(counts, np.int64)
        assert katz.unpacked(katz.packed(katz.narrow(n)))[0].astype(np.int64).tolist() == counts
    assert katz._hot(4, [np.array([3], np.uint64), np.array([1 << 33])], "Ql").find(np.array([3], np.uint64))[1].tolist() == [1 << 33]
