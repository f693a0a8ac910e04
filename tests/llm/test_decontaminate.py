import re

import pytest

from gridloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, x in items:
            v = words(x)
            n = min(window, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit.update(range(p, p + n))
                        names.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), sorted(names), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination(spark, make, texts, block):
    docs = [*enumerate(texts), (200, None), (201, ""), (5, texts[5]), (None, texts[9]), (202, "ONE, two\x00words")]
    items = [(k, texts[j][:400]) for k, j in enumerate((3, 9, 4, 15, 0, 21))] + [(77, "one"), (78, "Two words!"), (None, texts[27]), (79, None), (80, "..."), (81, "same same same"), (3, "other words"), (82, "same " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(make(docs), bench, block_bytes=block)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, sorted(r["items"]), r.contaminated) for r in got.collect()), key=str) == brute(docs, items)
    clean = D.drop_contaminated(make(docs), bench, block_bytes=block)
    assert clean.columns == make([]).columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((x[0] for x in brute(docs, items) if not x[2]), key=str)


def test_empty(spark, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(make([]), bench).collect() == []
    assert [r.n_hit for r in D.contamination(make([(1, "a b")]), bench).collect()] == [0]


def test_repeated_words(spark, make):
    """Items and texts of few different words, over and over: equal to brute force."""
    items = [(1, "a " * 60), (2, "a " * 40 + "b " + "a " * 40), (3, "a b " * 50), (4, "a " * 60), (5, "b " * 9), (6, "a a b " * 40), (7, ("a " * 12 + "c ") * 8)]
    docs = [(1, "a " * 200), (2, "b " * 30), (3, "a b " * 60), (4, "a a b " * 30 + "a " * 11), (5, "c " * 50), (6, "a " * 9 + "c " + "a " * 9), (7, "b a " * 5 + "b"), (8, ("a " * 12 + "c ") * 3)]
    got = D.contamination(make(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, sorted(r["items"]), r.contaminated) for r in got.collect()), key=str) == brute(docs, items)


def test_long_repeats_take_bounded_memory():
    """50,000 equal words in an item and in a text; the pairs of all their places would be 2.5 billion."""
    import tracemalloc

    text = b"0 " * 50_000
    tracemalloc.start()
    block = D.Block([("x", text), ("y", text + b"1")])
    totals = {k: D.np.zeros(len(c), D.np.int64) for k, c in block.codes.items()}
    block.count([text], totals)
    block.choose(totals)
    size, doc, first, end, where, item = block.hits([text, b"0 " * 9, b"1 0 " * 30])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (size[0], doc.tolist(), first.tolist(), end.tolist(), where.tolist(), item.tolist()) == (50_000, [0], [0], [50_000], [0, 0], [0, 1])
    assert peak < 300e6
