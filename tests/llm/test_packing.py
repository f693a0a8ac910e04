import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing
from gridloom.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Áb İ ΑΣ", "x\x01y \x01 z", "a<|endoftext|>B <|ENDOFTEXT|> c", "don't I'LL, we'd.", "1,000. ###, a b c\u0085d", "KK, ok.", "́ a", "\x00 a\x1cb\x0bc", "word.\n\nnext,\tlast."]


@pytest.mark.parametrize("cache", [300_000, 20])
def test_ids_are_the_tokenizers(texts, cache):
    own, known = Encoder(PATH, cache), Tokenizer.from_file(PATH)
    for text in [*ODD, *texts]:
        assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == known.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("limits", [(64, None, None), (64, 3, None), (64, None, 2500)])
def test_pack(make, texts, limits):
    tokens, documents, attention = limits
    if attention:
        tokens = 50
    rows = [*enumerate([*texts, *ODD]), (500, None), (7, texts[7]), (None, "")]
    got = packing.pack(make(rows), PATH, tokens=tokens, documents=documents, attention=attention, keep_ids=True).collect()
    known, want = Tokenizer.from_file(PATH), []
    for i, t in rows:
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, p // tokens, p, ids[p : p + tokens]) for p in range(0, len(ids), tokens)]
    assert sorted(((r.doc_id, r.piece, r.start, r.ids) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= tokens and len(own) <= (documents or tokens) and sum(n * n for _, n in own) <= (attention or tokens**2)
    total = sum(r.length for r in got)
    if not documents and not attention:
        assert len(bins) <= 1.05 * total / tokens + 2


def test_plan_rules():
    counts = {2048: 3, 1500: 100, 700: 60, 548: 150, 100: 500, 3: 10_000_000}
    for rule in ("norm", "dot"):
        found = packing.plan(counts, rule=rule)
        assert int(found["bins"][0]) >= -(-sum(k * v for k, v in counts.items()) // 2048)
        assert int(found["bins"][0]) <= 1.02 * sum(k * v for k, v in counts.items()) / 2048 + 2
    with pytest.raises(ValueError):
        packing.plan({2000: 1}, attention=100)


def test_empty(make):
    assert packing.pack(make([]), PATH).collect() == []
