import random

import pytest

from gridloom.llm import lines


def brute(rows, run):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        own = (rows[i][1] or "").split("\n")
        full = [j for j, x in enumerate(own) if x.strip(" ")]
        gone = set()
        for p in range(len(full) - run + 1):
            s = tuple(own[j] for j in full[p : p + run])
            if s in seen:
                gone.update(full[p : p + run])
            seen.add(s)
        out.append((rows[i][0], len(own), len(gone), "\n".join(x for j, x in enumerate(own) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("run,gram", [(2, 1), (3, 1), (4, 2), (1, 1)])
def test_runs(make, run, gram):
    r = random.Random(run)
    text = lambda n: "\n".join(r.choice(["alpha", "beta ", "gamma", "", "  ", "delta", "é ü", "x" * 50]) for _ in range(n))
    rows = [(i, text(r.randint(0, 14))) for i in range(50)] + [(60, None), (61, ""), (62, "\n\n"), (63, "a\r\nb"), (64, "one line"), (65, text(2000)), (None, "alpha\nbeta \ngamma")]
    got = lines.drop_repeated_runs(make(rows), run=run, gram=gram).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, run)


def test_repeated_ids_and_empty(make):
    got = lines.drop_repeated_runs(make([(1, "a\nb"), (1, "a\nb"), (1, "a\nb")])).collect()
    assert sorted(r.n_removed for r in got) == [0, 2, 2]
    assert lines.drop_repeated_runs(make([])).collect() == []


def test_seeds_are_the_selected_minima(make):
    """One row for each selected fingerprint: fewer than windows, and every window lies in the context of the seed it selected."""
    r = random.Random(3)
    own = [r.choice("abcdefghij") * 3 for _ in range(300)]
    docs = make([(0, "\n".join(own))]).selectExpr("doc_id AS key", "text")
    for run, gram in ((2, 1), (5, 1), (4, 2)):
        found = sorted((s.start, [x.line for x in s.context]) for s in lines.seeds(docs, run, gram).collect())
        windows = [own[p : p + run] for p in range(300 - run + 1)]
        assert [x[i : i + run] for _, x in found for i in range(len(x) - run + 1)] == windows
        assert len(found) < len(windows)


def test_long_texts_take_linear_time(make):
    """50,000 lines that are all removed from the second text, and an equal line 50,000 times."""
    text = "\n".join(f"line {i}" for i in range(50_000))
    rows = [(1, text), (2, text), (3, "\n".join(["same"] * 50_000))]
    got = {r.doc_id: r for r in lines.drop_repeated_runs(make(rows)).collect()}
    assert [(got[i].n_lines, got[i].n_removed) for i in (1, 2, 3)] == [(50_000, 0), (50_000, 50_000), (50_000, 49_999 + 0)]
    assert got[1].kept == text and got[2].kept == "" and got[3].kept == "same"
