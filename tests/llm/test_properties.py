import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import arrow, katz, packing, substring, suffix, windows


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=20, max_size=200).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 12), st.integers(1, 4))
def test_suffix_sort(text, cap, groups):
    own = suffix.Suffixes(np.frombuffer(text, np.uint8), cap)
    at = np.arange(len(text) - cap + 1)
    group = np.sort(at % groups)
    want = sorted(range(len(at)), key=lambda i: (group[i], text[at[i] : at[i] + cap], i))
    assert own.sort(at, group).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(values):
    seq = np.array([*values, -1], np.int64)
    assert substring.suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), max_size=30))
def test_merged_intervals(spans):
    a, b = arrow.merged(np.array([s for s, _ in spans], np.int64), np.array([s + n for s, n in spans], np.int64))
    covered = {x for s, n in spans for x in range(s, s + n)}
    assert covered == {x for s, e in zip(a.tolist(), b.tolist(), strict=True) for x in range(s, e)}
    assert all(s > e for e, s in zip(b.tolist(), a.tolist()[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_planes(values):
    ids = np.sort(np.array(values, np.uint64))
    assert katz.unplanes(katz.planes(ids)).tolist() == ids.tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab ", max_size=80), min_size=1, max_size=5), st.booleans())
def test_anchors_deal_out_each_window_once(texts, words):
    n, k = 6, 3
    batch = windows.Batch([t.encode() for t in texts], words)
    found = windows.Anchors(batch, n, k)
    place = {}
    for doc, start, more, anchor in zip(found.doc.tolist(), found.start.tolist(), found.more.tolist(), found.anchor.tolist(), strict=True):
        for w in range(start, start + more + 1):
            assert (doc, w) not in place and w <= anchor <= w + n - k
            place[doc, w] = anchor - w
    assert len(place) == sum(max(0, s - n + 1) for s in batch.size.tolist())
    same = {}
    for (_, w), offset in place.items():  # equal windows have their anchor at the same place
        assert same.setdefault(tuple(batch.tokens[w : w + n].tolist()), offset) == offset


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=12), st.sampled_from([None, 3, 10]), st.sampled_from([None, 64 * 64, 5000]))
def test_plans_fit(counts, documents, attention):
    p = packing.plan(counts, 64, documents, attention)
    seen = {}
    bins = {}
    for length, rank, first, each, offset in zip(*(p[c].tolist() for c in ("length", "rank", "bin", "each", "offset")), strict=True):
        end = min([r for n, r in zip(p["length"].tolist(), p["rank"].tolist(), strict=True) if n == length and r > rank], default=counts[length])
        for i in range(end - rank):
            bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
            seen[length] = seen.get(length, 0) + 1
    assert seen == {k: v for k, v in counts.items() if v}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64 and len(own) <= (documents or 64) and sum(n * n for _, n in own) <= (attention or 64 * 64)
