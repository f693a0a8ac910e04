import random

import pytest
from pyspark.sql import types as T

#: documents with a column whose name an operator uses inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n.words", T.LongType())])


def corpus(seed=7, n=60):
    """Texts with copies, near copies, shared passages, repeated and short words, empty and null ones and one long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["the", "an", "Er", "ß", "é", "on", "ti", "x1"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", ".", "\n"]) for _ in range(k))
    passages = [text(60) for _ in range(3)]
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            out.append(text(r.randint(1, 120)))
        elif kind == 1:
            out.append(r.choice([x for x in out if x]))
        elif kind == 2:
            own = r.choice([x for x in out if x]).split(" ")
            own[r.randrange(len(own))] = "changed"
            out.append(" ".join(own))
        elif kind == 3:
            out.append(text(20) + " " + r.choice(passages) + " " + text(15))
        elif kind == 4:
            out.append(r.choice(passages) + "\n\n" + r.choice(passages)[:r.randint(80, 300)])
        else:
            out.append(r.choice(["", " \n", "one", "two words", "1 2 3", "same same same " * 30, text(3000) if i == 17 else text(40)]))
    return out


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture
def make(spark):
    def of(rows):
        return spark.createDataFrame([(i, t, "en", "k", 1) for i, t in rows], SCHEMA)

    return of
