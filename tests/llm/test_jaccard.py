import os
import random

import corpus_pipeline
from gridloom.llm import common, jaccard


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, similarity=0.8):
    """Rows in the order of their ids that no chain of similar pairs leads to an earlier one."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    for _ in rows:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return [r for i, r in enumerate(rows) if label[i] == i], near


def test_verified_stage(spark, make, texts):
    """Near copies whose fingerprints are 5 to 14 bits apart go, and documents that share a fingerprint alone stay."""
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "12 34"), (103, " ".join(f"w{i}" for i in range(49))), (104, " ".join(f"w{i}" if i != 20 else "x" for i in range(49))), (105, texts[0] + " x")]
    rows += [(106, " ".join(f"v{i}" for i in range(48))), (107, " ".join(f"v{i}" if i != 20 else "x" for i in range(48))), (None, texts[9])]
    kept, near = brute(rows)
    stage = dict(corpus_pipeline.VERIFIED)["verified near-dedup"]
    got = stage(spark, make(rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(kept, key=str)
    ids = {r.doc_id for r in got}
    assert 104 not in ids and 107 in ids and len(near) > 10
    assert len(corpus_pipeline.fingerprint_near_dedup(spark, make(rows), "").collect()) > len(got)


def test_similar_through_fingerprints(spark, make):
    """Texts of 150 words and copies with changed words: what goes has a similar text before it, and nine in ten near copies go."""
    r = random.Random(4)
    base = [[f"w{r.randrange(3000)}" for _ in range(150)] for _ in range(40)]
    rows = []
    for i, words in enumerate(base):
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 6):
            own = list(words)
            for at in r.sample(range(150), j):
                own[at] = "changed"
            rows.append((10 * i + j, " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, "short text"), (1003, "short text"), (None, "short text"), (1004, " ".join(base[0][:75]))]
    kept, near = brute(rows)
    got = {(x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, make(rows), "").collect()}
    assert got >= set(kept)
    assert len(rows) - len(got) >= 0.9 * (len(rows) - len(kept)) and len(near) > 150


def test_groups_of_near_copies_are_not_expanded(spark, make):
    """The components of linked() are those of all similar pairs, also in a group of 300 near copies."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if k != i % 120 else f"x{i}" for k, w in enumerate(words))) for i in range(300)] + [(400 + i, " ".join(r.sample(words, 40))) for i in range(30)]
    kept, near = brute(rows)
    docs = make(rows).selectExpr("doc_id AS key", "text")
    gone = {x.node for x in jaccard.linked(docs).collect() if x.node != x.root}
    assert {i for i, _ in rows} - gone == {i for i, _ in kept} and len(near) > 40_000


def test_empty(spark, make):
    assert corpus_pipeline.verified_near_dedup(spark, make([]), "").collect() == []


def test_no_link_is_missed(spark, make):
    """Pairs at a similarity of just 0.8, whose fingerprints may be far apart."""
    r = random.Random(6)
    rows = []
    for i in range(40):
        words = [f"w{r.randrange(9000)}" for _ in range(49)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(w if k != 20 else "changed" for k, w in enumerate(words)))]
    kept, near = brute(rows)
    assert len(kept) == len(near) == 40
    assert sorted((x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, make(rows), "").collect()) == sorted(kept)


def test_pairs_of_a_group_are_not_candidates(spark, make, monkeypatch):
    """Of 300 near copies few pairs are compared, and the result is that of all pairs."""
    compared, real = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda near, *more: compared.append(near.count()) or real(near, *more))
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if k != i % 120 else f"x{i}" for k, w in enumerate(words))) for i in range(300)]
    rows += [(300 + i, " ".join(words[:104] + [f"y{i}"] * 3)) for i in range(3)]
    kept, near = brute(rows)
    assert sorted((x.doc_id, x.text) for x in corpus_pipeline.verified_near_dedup(spark, make(rows), "").collect()) == sorted(kept)
    assert len(near) > 40_000 and sum(compared) < 10 * len(rows)


def test_tables_go_when_the_next_is_written(spark, make, texts, monkeypatch):
    """The large tables of near-dedup are gone at its end, none of them is there beside the lists but marks, and rows of lists have no marks."""
    made, real, beside = [], common.staged, []
    there = lambda: {name for name, t in made if os.path.exists(t.staged_path.removeprefix("file://"))}

    def staged(df, name, by=None):
        made.append((name, real(df, name, by)))
        if name == "firsts":
            beside.append(there())
        return made[-1][1]

    monkeypatch.setattr(common, "staged", staged)
    near = corpus_pipeline.near_dedup(spark, make([*enumerate(texts)]), "").collect()
    assert near and len(beside) == 2 and not {"signed", "prefix", "shared", "fingerprints"} & (beside[0] | beside[1])
    assert not {"fingerprints", "compared", "signed", "marks", "prefix", "shared", "lists", "firsts", "met", "sets", "rooted", "mixed", "mixed_lists"} & there()
    assert all("marks" not in t.columns for name, t in made if name in ("lists", "rooted"))


def test_large_sets_without_marks(spark, make):
    """Pairs of which one or both have too many shingles for marks."""
    r = random.Random(9)
    rows = []
    for i, (wide, cut) in enumerate([(1300, 1100), (1300, 1000), (2000, 1700), (2000, 1500), (1150, 1000), (1160, 1155)]):
        words = [f"w{r.randrange(90_000)}" for _ in range(wide)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:cut]))]
    kept, near = brute(rows)
    assert len(near) == 4
    assert sorted((x.doc_id, x.text) for x in corpus_pipeline.verified_near_dedup(spark, make(rows), "").collect()) == sorted(kept)
