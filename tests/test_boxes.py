import numpy as np
import pyarrow as pa
import pytest

from gridloom.functions import boxes as B


def fold(box, sure, single, threshold):
    """Box by box, as suppression in rounds is defined."""
    out, kept, left = [], [], []
    for b, s, one in zip(box, sure, single, strict=True):
        near = lambda others: any(B.iou(b, o) > threshold for o in others)
        out.append(B.FREE if s else B.DROPPED if near(kept) else B.OPEN if near(left) else B.FREE)
        if s or (one and out[-1] == B.FREE):
            kept.append(b)
        elif out[-1] != B.DROPPED:
            left.append(b)
    return out


@pytest.mark.parametrize("block,pairs", [(1024, 1 << 20), (8, 64)])
def test_verdicts_of_many_groups_at_once(monkeypatch, block, pairs):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "PAIRS", pairs)
    r = np.random.default_rng(1)
    first = np.array([0, 1, 9, 10, 75])
    corner = r.uniform(0, 0.4, (120, 2))
    box = np.concatenate([corner, corner + r.uniform(0.1, 0.5, (120, 2))], axis=1)
    sure, single = r.random(120) < 0.1, r.random(120) < 0.7
    want = sum((fold(box[a:b], sure[a:b], single[a:b], 0.3) for a, b in zip(first, [*first[1:], 120], strict=True)), [])
    assert B.decide(box, first, sure, single, B.iou, 0.3).tolist() == want and len(set(want)) == 3


def test_groups_over_batches():
    rows = [(None, 1), (None, 2), (0, 3), (0, 4), (0, 5), (1, 6)]
    batches = [pa.RecordBatch.from_pylist([{"k": k, "v": v} for k, v in rows[a:b]], schema=pa.schema([("k", pa.int64()), ("v", pa.int64())])) for a, b in ((0, 1), (1, 3), (3, 3), (3, 5), (5, 6))]
    got = [(p.column("v").to_pylist(), first.tolist()) for p, first in B.whole_groups(iter(batches), ["k"])]
    assert sum((v for v, _ in got), []) == [1, 2, 3, 4, 5, 6]
    assert [sum(v[a:b]) for v, f in got for a, b in zip(f, [*f[1:], len(v)], strict=True)] == [3, 12, 6]
