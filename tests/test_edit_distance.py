"""Batches of pairs, and pairs cut into cells, against the plain recurrence."""

import random

import pytest

from pagetext.functions import edit_distance as ed
from pagetext.operators import long_pairs

from plain import distance


def changed(rng, text, rate):
    out = []
    for c in text:
        x = rng.random()
        if x < rate / 3:
            continue
        if x < 2 * rate / 3:
            out.append(rng.choice("ab é世"))
        out.append(rng.choice("abc ") if x < rate else c)
    return "".join(out)


def drawn(rng, lengths):
    a = "".join(rng.choice("abcdefg \U0001F600") for _ in range(rng.choice(lengths)))
    return a, changed(rng, a, rng.choice([0, 0.05, 0.4, 0.9])) if rng.random() < 0.7 else changed(rng, a[::-1], 0.2)


@pytest.mark.parametrize("tokens", [False, True])
@pytest.mark.parametrize("lanes, entries", [(8192, 1 << 22), (5, 1 << 22), (8192, 4)])
def test_batches_equal_the_recurrence(monkeypatch, tokens, lanes, entries):
    monkeypatch.setattr(ed, "BATCH_LANES", lanes)
    monkeypatch.setattr(ed, "TABLE_ENTRIES", entries)
    rng = random.Random(7)
    pairs = [drawn(rng, [0, 1, 2, 40, 63, 64, 65, 127, 128, 129, 260]) for _ in range(120)]
    pairs += [("", ""), ("", "a"), ("abc", ""), ("a" * 300, "a" * 300), ("a" * 200, "b" * 70), ("ab" * 100, "ba" * 100)]
    got = ed.batch_distances([ed.pair_of_codes(a, b, tokens) for a, b in pairs])
    cut = (lambda x: x.encode().split()) if tokens else list
    assert got == [distance(cut(a), cut(b)) for a, b in pairs]


@pytest.mark.parametrize("tokens", [False, True])
def test_long_pairs_are_cut_into_cells(spark, tokens):
    rng = random.Random(11)
    pairs = [drawn(rng, [200, 300, 350]) for _ in range(6)]
    pairs += [("x" * 400, "y" * 390), ("ab" * 200, "ba" * 150), ("short", "shirt"), (" " * 300, "a b " * 80), (None, "a" * 400), ("", "b")]
    pairs += pairs[:1]
    rows = [(i // 2, a, b, "kept") for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "pid long, ref string, hyp string, distance string")
    out = long_pairs.with_distance(df, "ref", "hyp", "d", tokens, cell=128, whole=1)
    cut = (lambda x: x.encode().split()) if tokens else list
    want = [(i, a, b, None if a is None else distance(cut(a), cut(b))) for i, a, b, _ in rows]
    assert out.columns == ["pid", "ref", "hyp", "distance", "d"]
    assert sorted(((r.pid, r.ref, r.hyp, r.d) for r in out.collect()), key=str) == sorted(want, key=str)
    again = long_pairs.with_distance(df.limit(2), "ref", "hyp", "distance", tokens, cell=1024)
    assert again.columns == ["pid", "ref", "hyp", "distance"] and dict(again.dtypes)["distance"] == "bigint"
    assert long_pairs.with_distance(df.limit(0), "ref", "hyp", "d", tokens).collect() == []


def test_a_wide_pair_is_several_rows_of_a_round(spark):
    """Each anti-diagonal of a pair's grid is dealt over tasks by its cells."""
    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcd") for _ in range(64 * 6)) for _ in range(2))
    todo = spark.createDataFrame([(1, 384, 384, 384)], "pid long, m long, n long, k long")
    rows = spark.createDataFrame([(1, a, b)], "pid long, ref string, hyp string")
    parts = [long_pairs.pieces(rows, side, False, 64) for side in ("ref", "hyp")]
    assert [p.count() for p in parts] == [6, 6]
    assert long_pairs.within_band(todo, *parts, False, 64).first()["distance"] == distance(a, b)


def test_wer_of_whole_documents(spark):
    from pagetext.plans import catalog, fixtures
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: distance(r.ref.split(), r.hyp.split()) / max(1, len(r.ref.split()))
            for r in fixtures.fx_wer_documents(spark, sf).where("length(ref) < 2500").collect()}
    got = {r.doc_id: r.wer for r in catalog.QUERIES["wer_documents"](spark, sf).collect()}
    assert len(got) == fixtures.fx_wer_documents(spark, sf).count() and len(want) > 10
    assert all(abs(got[i] - w) < 1e-6 for i, w in want.items())


def test_misread_characters_need_no_sweep(monkeypatch):
    """Hamming's distance that is also a lower bound is the distance; other pairs are swept."""
    from pagetext.functions import edit_distance as ed
    swept = []
    banded = ed.banded
    monkeypatch.setattr(ed, "banded", lambda pairs, bound: (swept.append(len(pairs)), banded(pairs, bound))[1])
    assert ed.levenshtein("oil on soil " * 500, "0i1 0n s0i1 " * 500) == 2500 and not swept
    assert ed.levenshtein("abcabcabc", "bcabcabca") == 2 and swept
    far = chr(0x1F600)
    assert ed.levenshtein("a" + far, "b" + far) == 1 and ed.levenshtein(far + "ab", "x" + "ba") == 3
