import hashlib
import random
import re

import numpy as np
import pytest

from pagetext.llm import pii

from .helpers import DOCS, frame, odd_documents

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = ["mail a.b@c.de, x@y, @z.com a@b.c@d.e.f", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 255.255.255.255 9999.1.1.1",
       "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111", "+1 (499) 555-6503 +123 +49 30 123456 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
       "call (499) 555-6503 now", "é😀 +44 20 7946 0958 😀 ü@ü.de user@host.example.org.", "a" * 5000 + "@" + "b" * 5000 + ".com",
       "joe (at) example (dot) org", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "@@@@ ++++ .... 1-2-3", None, ""]


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def by_hand(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def messy(n=80):
    rng = random.Random(2)
    bits = ["a@b.co", "x.y+z@mail.example.com", "10.0.0.1", "1.2.3", "4111 1111 1111 1111", "+1 (499) 555-6503", "+", "@", ".", " ", "-", "12", "word", "é", "(", ")", "5500000000000004"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_base_spans_equal_the_patterns(spark):
    texts = ODD + messy()
    rows = [(1000 + i, t, "", "", 0) for i, t in enumerate(texts)] + odd_documents()
    got = pii.personal_data(frame(spark, rows, clashing=("spans", "found", "n_ip"))).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        want = by_hand(text[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [(s["kind"], s["start"], s["end"]) for s in r["found"] if s["base"]] == want


def test_added_spans_touch_no_base_span(spark):
    rows = [(i, t, "", "", 0) for i, t in enumerate(ODD + messy(300))]
    for r in pii.personal_data(frame(spark, rows), threshold=0.0).collect():
        base = [(s["start"], s["end"]) for s in r["found"] if s["base"]]
        assert not any(s["start"] < e and b < s["end"] for s in r["found"] if not s["base"] for b, e in base)


def test_method_adds_what_the_labelers_agree_on(spark):
    rng = random.Random(4)
    rows = [(i, f"call me: +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} today", "", "", 0) for i in range(200)]
    rows += [(300 + i, f"tel: ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or", "", "", 0) for i in range(20)]
    rows += [(400 + i, f"version 999.{i}.1.1 of 4111111111111{i:03d}9999 plain words 12 34", "", "", 0) for i in range(50)]
    got = {r["doc_id"]: [(s["kind"], s["base"]) for s in r["found"]] for r in pii.personal_data(frame(spark, rows)).collect()}
    assert all(got[i] == [("phone", True)] for i in range(200))
    assert all(got[300 + i] == [("phone", False)] for i in range(20))
    assert all(("ip", False) not in got[400 + i] for i in range(50))


def test_em_recovers_known_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.85, 0.7, 0.9])
    v = np.where(rng.random((20000, 6)) < right, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.random(v.shape) < 0.2] = -1
    p, rates = pii.reliabilities(v, np.ones(len(v)))
    assert np.abs(rates[1] - right).max() < 0.03 and np.abs(1 - rates[0] - right).max() < 0.03
    assert ((p > 0.5) == truth).mean() > 0.97


def test_masking(spark):
    rows = [(1, "é mail a@b.co and 10.0.0.1.", "", "", 0), (2, None, "", "", 0), (3, "plain", "", "", 0)]
    got = {r["doc_id"]: r["text"] for r in pii.masked(frame(spark, rows)).collect()}
    assert got == {1: "é mail <email> and <ip>.", 2: "", 3: "plain"}


@pytest.mark.parametrize("schema", [DOCS])
def test_empty_table(spark, schema):
    assert pii.personal_data(frame(spark, [], schema)).count() == 0


def test_rejected_candidates_hide_no_others(spark):
    """A failed card run over a phone number, and an upper-case spelt address."""
    rng = random.Random(6)
    head = ["2024 ", "2024-01-15 "]

    def number():
        """A phone number that does not end a valid card number."""
        n = f"555-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        return number() if any(pii.luhn(pii.digits(h + n)) for h in head) else n
    rows = [(i, f"tel: {head[i % 2]}{number()} or", "", "", 0) for i in range(20)]
    rows += [(100 + i, f"tel: {number()} or", "", "", 0) for i in range(200)]
    rows += [(400 + i, f"mail joe{i} {'(AT)' if i % 2 else '[At]'} example (DOT) org", "", "", 0) for i in range(10)]
    rows += [(500 + i, f"contact a.b{i}@mail.example.com today", "", "", 0) for i in range(100)]
    assert all((pii.PHONE, t.index("555"), t.index("555") + 12) in pii.spans(t)[1] for _, t, *_ in rows[:20])
    assert all(pii.spans(t)[1] == [(pii.EMAIL, 5, len(t))] for i, t, *_ in rows if 400 <= i < 500)
    got = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["found"]] for r in pii.personal_data(frame(spark, rows)).collect()}
    assert all(got[i] == [("phone", rows[i][1].index("555"))] for i in range(20))


def test_overlaps_go_to_the_more_probable():
    span = lambda kind, start, end, votes, base=False: dict(kind=kind, start=start, end=end, base=base, votes=votes, bits=0)
    found = pii.resolved([span(0, 90, 95, 0, True), span(2, 0, 20, 1), span(3, 5, 17, 2), span(3, 20, 30, 1), span(3, 28, 40, 9)],
                         {(2, 1, 0): 0.91, (3, 2, 0): 0.99, (3, 1, 0): 0.95})
    assert [(s["kind"], s["start"], s["end"]) for s in found] == [("email", 90, 95), ("phone", 5, 17), ("phone", 20, 30)]


def test_address_search_is_linear_and_leftmost():
    import random
    import re
    import time
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("0123..  x") for _ in range(rng.randint(1, 40)))
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in pii.BASE_IP.finditer(text)]
    t = time.perf_counter()
    pii.spans("7" * 1_000_000)
    assert time.perf_counter() - t < 2
