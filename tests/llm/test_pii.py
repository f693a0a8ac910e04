import hashlib
import re

from gridloom.llm import pii

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(t):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and pii._luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    "mail a@b.c.d, x.y%z+1@h-1.de.%u@v.w.x@y.z é😀 q@r.s@t.u", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.09 1.2.3.999 99999999999999999999.1.1.1", "4111 1111 1111 1111 5500-0000-0000-0004 4111111111111112 37828224631000512345",
    "+1 (702) 555-0742 +49-30-1234567. +1 2 +123456789012345678 +1-2-3-4-5-6-7-8--9 ++12345678", "4111111111111111 5500000000000004", "joe (at) example (dot) com, joe [at] example.org",
    "tel. (702) 555-0742 on 2024-05-06 1234", "aaaa" * 30_000, "1" * 60_000, "a.b" * 5000 + "@", "1 " * 20_000, "id 4111-1111-1111-1111x", "2001:db8:85a3:1:2:8a2e:370:7334 here", None, "", "É@é.com a@b..c @ .@-.x",
]


def test_base_and_added(make, texts):
    rows = [*enumerate([*texts, *ODD]), (5, texts[5]), (None, ODD[3])]
    text = {i: t for i, t in rows}
    for r in pii.personal_data(make(rows)).collect():
        want = brute(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in KINDS], text[r.doc_id][:80]
        written = ["%s:%d:%d" % w for w in want]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",") if r.spans else [])
    got = {r.doc_id: r.spans for r in pii.personal_data(make(rows)).collect()}
    n = len(texts)
    assert got[n + 4] == "card:0:16,card:17:33"
    assert got[n + 5] == "email:0:26,email:28:48"
    assert got[n + 6] == "phone:5:19"
    assert got[n + 12] == "ip:0:31"
    assert all(not got[i] for i in range(n))


def test_redacted(make):
    df = make([(1, "to a@b.cd and 1.2.3.4!"), (2, None), (3, "none"), (4, "4111111111111111 5500000000000004")])
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert pii.redacted(df).columns == df.columns
    assert got == {1: "to [EMAIL] and [IP]!", 2: None, 3: "none", 4: "[CARD] [CARD]"}


def test_empty(make):
    assert pii.personal_data(make([])).collect() == []


def test_many_matches_take_linear_time(make):
    """One text of 4,000 addresses and as many written out: all found; twice as many take about twice as long."""
    import time

    def run(n):
        text = " ".join(f"user{i}@mail{i}.org, joe{i} (at) host{i} (dot) com;" for i in range(n))
        began = time.time()
        (r,) = pii.personal_data(make([(1, text)])).collect()
        return r, text, time.time() - began

    run(10)
    r, text, one = run(2000)
    _, _, two = run(4000)
    assert r.n_email == 2000 and r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % w for w in brute(text)).encode()).hexdigest()
    assert len(r.spans.split(",")) == 4000
    assert two < 3 * one + 3
