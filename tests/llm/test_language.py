import zlib

import numpy as np
import pytest

from gridloom.llm import language as L

PARTS = {"xx": ["ka", "lo", "mi", "ru"], "yy": ["sch", "ung", "ä", "ber"], "zz": ["tion", "eau", "é", "ou"]}


def document(lang, r, n):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.integers(1, 4))) for _ in range(n))


def brute(field, e):
    n, k = e.shape
    total = np.zeros((n, k))
    import itertools

    for path in itertools.product(range(k), repeat=n):
        s = field.start[path[0]] + sum(e[t, y] for t, y in enumerate(path)) + sum(field.move[a, b] for a, b in itertools.pairwise(path))
        for t, y in enumerate(path):
            total[t, y] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_marginals():
    r = np.random.default_rng(0)
    field = L.Field(["a", "b", "c"])
    field.start, field.move = r.normal(size=3), r.normal(size=(3, 3))
    sizes = [1, 5, 7, 2, 6]
    e = r.normal(size=(sum(sizes), 3))
    begins = np.cumsum(sizes) - sizes
    got = field.marginals(e, begins, steps=4)
    for b, n in zip(begins, sizes, strict=True):
        assert np.allclose(got[b : b + n], brute(field, e[b : b + n]))


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(1)
    return [(i, document(lang, r, int(r.integers(5, 80))), lang) for i, lang in enumerate(r.choice(list(PARTS), 200).tolist())]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark, corpus):
    odd = [(900, None, "xx"), (901, "12 34 ²½ _", "xx"), (902, "", None), (903, "ka lo", None), (None, "sch ung", "yy"), (5, corpus[5][1], corpus[5][2]), (904, "ka" * 5000, "xx")]
    df = frame(spark, [(*x, "s") for x in corpus + odd])
    got = L.identify(df).collect()
    assert len(got) == len(corpus) + len(odd)
    truth = {i: lang for i, _, lang in corpus}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (r.doc_id in (900, 901, 902))
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(got) - 3


def test_code_switching(corpus):
    segments = [(lang, t.split()[:25]) for _, t, lang in corpus]
    field = L.fit(segments)
    assert all(field.move[i, i] > field.move[i, j] for i in range(3) for j in range(3) if i != j)
    r = np.random.default_rng(4)
    text = L.words(document("xx", r, 15) + " " + document("yy", r, 15))
    label = field.marginals(field.emissions(text), np.array([0])).argmax(axis=1)
    assert (np.array([field.labels[y] for y in label]) == ["xx"] * 15 + ["yy"] * 15).mean() > 0.9


def test_empty_and_unlabelled(spark):
    assert L.identify(frame(spark, [])).collect() == []
    assert [r.lang_pred for r in L.identify(frame(spark, [(1, "ab cd", None, "s")])).collect()] == ["und"]


def test_kept_rows_whatever_way_the_text_goes(spark, corpus):
    """A text inside its row, and one that is cast first, leave the same rows; many slices of a batch keep rows and languages together."""
    from pyspark.sql import functions as F

    odd = [(None, corpus[3][1], "xx"), (7, None, "xx"), (8, "1 2", None), (9, "", "yy"), *[corpus[5]] * 3, (910, "ka lo " * 60_000, "xx")]
    df = frame(spark, [(*x, str(i)) for i, x in enumerate(corpus + odd)]).coalesce(2)
    field = L.fitted(df)
    rows = df.select(F.struct(*df.columns).alias("row"), "text")
    judged = L.predict(rows, field).filter("lang_pred != 'und' AND score >= 0.6")
    wanted = sorted(r.row.score for r in judged.collect())
    assert sorted(r.score for r in L.keep_identified(df, least=0.6, field=field).collect()) == wanted
    assert sorted(r.score for r in L.keep_identified(df.withColumn("text", F.col("text").cast("binary")), least=0.6, field=field).collect()) == wanted
    assert L.keep_identified(df.limit(0), field=field).collect() == [] and L.keep_identified(df.limit(0)).collect() == []
