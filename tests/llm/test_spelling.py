import random
import re
import zlib
from collections import Counter

from gridloom.llm import spelling


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, letters=6, least=5, ratio=5, marred=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % marred else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    close = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def run(df, **more):
    return sorted(map(tuple, spelling.spelling_groups(df, **more).collect()))


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abßÉé") for _ in range(r.randint(5, 9))) for _ in range(25)]

    def other(w):
        i = r.randrange(len(w) + 1)
        return r.choice([w[:i] + r.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("abß") + w[i + 1 :]])

    words = [(w, r.choice([1, 5, 30, 200])) for w in base]
    words += [(other(w), r.choice([1, 2, 5, 6])) for w, _ in words for _ in range(4)]
    words += [(other(other(w)), 1) for w, _ in words]
    each = [w for w, k in words for _ in range(k)]
    r.shuffle(each)
    return [(i, r.choice([" ", "-", "1\n"]).join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in each[i * 40 : i * 40 + 40])) for i in range(len(each) // 40 + 1)]


def test_against_all_pairs(make):
    for seed in range(3):
        rows = [*corpus(seed), (900, None), (901, ""), (902, "12 !"), (None, "wordlike wordlike"), (7, "wordlike " * 3)]
        want = brute(rows, marred=7)
        assert run(make(rows), marred=7) == want and sum(w[1] is not None for w in want) > 3


def test_chains_and_ties(make):
    rows = [(i, "letters " * 250 + "letterz " * 50 + "letterzz " * 10 + "setters " * 250 + "betters " * 50 + "aaaaaab " * 40 + "aaaaaaab " * 8) for i in range(1)]
    got = {w: x for w, *x in run(make(rows), marred=10**9)}
    assert got["letterzz"][:2] == ["letterz", "letters"] and got["letterz"][:2] == ["letters", "letters"] and got["letters"][:2] == [None, "letters"]
    assert got["betters"][:2] == ["letters", "letters"]  # a tie with setters: the smaller
    assert got["aaaaaaab"] == ["aaaaaab", "aaaaaab", 8, 1, 40] and got["aaaaaab"][3] == 1


def test_long_words(make):
    long = "xyz" * 20_000
    rows = [(0, (long + " ") * 30 + (long[:30_000] + "q" + long[30_000:] + " ") * 5 + (long[:-1] + "y ") * 6)]
    want = [(w[:5], w[-2:], len(w), n, k) for w, _, _, n, k, _ in run(make(rows), marred=10**9)]
    assert sorted(want) == [("xyzxy", "yy", 60_000, 6, 1), ("xyzxy", "yz", 60_000, 30, 2), ("xyzxy", "yz", 60_001, 5, 1)]


def test_tables_beyond_the_broadcast_limit(make, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(spelling.C, "BROADCAST_BYTES", 0)
    assert run(make(rows), marred=7) == brute(rows, marred=7)


def test_empty(make):
    assert run(make([])) == [] and run(make([(1, None), (2, "few words here")])) == []
