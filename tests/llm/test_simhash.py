import numpy as np
import pytest
import xxhash

from gridloom.llm import simhash as S


def fingerprint(t, n=3):
    w = (t or "").encode().lower().split()
    own = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, fps, most=3):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= most:
                    label[i], changed = label[j], True
    low = {}
    for i, k in zip(ids, label, strict=True):
        if i is not None:
            low[k] = min(i, low.get(k, i))
    return [low.get(k) for k in label]


def test_groups(make, texts):
    rows = [*enumerate(texts), (300, None), (301, ""), (5, texts[5]), (None, "alone here now and then")]
    fps = [fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute([i for i, _ in rows], fps), strict=True), key=str)
    assert sorted(map(tuple, S.simhash_groups(make(rows)).collect()), key=str) == want


@pytest.mark.parametrize("group", [10_000, 20])
def test_links(spark, group):
    r = np.random.default_rng(3)
    fps = []
    for base in r.integers(0, 2**63, 12):
        for _ in range(r.integers(1, 40)):
            x = int(base)
            for k in r.integers(0, 64, r.integers(0, 4)):
                x ^= 1 << int(k)
            fps.append(x)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    from gridloom.llm.components import components

    root = {r.node: r.root for r in components(S.edges_within(nodes, 3, group)).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    assert brute(signed, fps) == [min(y for y in signed if root.get(y, y) == root.get(x, x)) for x in signed]


def test_empty(make):
    assert S.simhash_groups(make([])).collect() == []


@pytest.mark.parametrize("most", [3, 9])
def test_neighbours_within_a_wider_radius(spark, most):
    """Exactly the rows with a neighbour that agrees on a block; within three bits all neighbours do."""
    r = np.random.default_rng(8)
    prints = []
    for base in r.integers(0, 2**63, (40, 2)):
        for _ in range(r.integers(1, 6)):
            prints.append([int(x) ^ sum(1 << int(k) for k in set(r.integers(0, 64, r.integers(0, 14)).tolist())) for x in base])
    prints += [prints[0], [prints[1][0], 5]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    made = spark.createDataFrame([(i, [signed(x) for x in p]) for i, p in enumerate(prints)], "key long, prints array<long>")

    def near(a, b):
        x = a ^ b
        return x.bit_count() <= most and any(not x >> 16 * k & 0xFFFF for k in range(4))

    want = {i for i, p in enumerate(prints) for j, q in enumerate(prints) if i != j and any(near(a, b) for a, b in zip(p, q, strict=True))}
    assert {x.key for x in S.neighboured(made, most).collect()} == want and 20 < len(want) < len(prints)
