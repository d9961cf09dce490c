import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagetext.llm import alignment as al

from .helpers import DOCS, frame, odd_documents

ODD = ["aaaa aaaaaa aaa", "  two  blanks ", "\n\nx\n", "a ▁ b", "日本語 ñandú 😀😀 z", "x\x00y", "line\r\ntab\t end ", " ", "<0x41> <s> <|endoftext|> <unk>",
       "http://example.com/a?b=c", "1234567890", "naïve café — “quoted”", "́ combining", "x" * 300]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(al.A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=al.B_PATH)
    ours = al.aligner(al.A_PATH, al.B_PATH)
    return a, b, ours.a.bytes_of, ours.b.bytes_of


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(of[i]), i))
        at += len(of[i])
    return out


def brute(texts, models):
    a_model, b_model, a_bytes, b_bytes = models
    held, rows, counts = [], [], Counter()
    for t in texts:
        a = spans(a_model.encode(" " + t, add_special_tokens=False).ids, a_bytes) if t else []
        b = spans(b_model.encode(t), b_bytes) if t else []
        whole = (" " + (t or "")).encode()
        if b"".join(a_bytes[i] for *_, i in a) != whole or b"".join(b_bytes[i] for *_, i in b) != whole:
            a = b = []
        links = [(i, j) for s, e, i in a for x, y, j in b if s < y and x < e]
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, start = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for s, e, i in a if start < e <= c) + "|" + ",".join(str(i) for s, e, i in b if start < e <= c))
            start = c
        held.append(links)
        counts.update(set(links))
        rows.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(na, nb, ng, nl, sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), sha)
            for (na, nb, ng, nl, sha), ls in zip(rows, held)]


@pytest.mark.parametrize("block", [500, 8 << 20])
def test_rows_equal_brute_force(spark, models, monkeypatch, block):
    monkeypatch.setattr(al, "BLOCK_BYTES", block)
    rng = random.Random(7)
    rows = [r for r in odd_documents() if r[0] != 306] + [(900 + i, t, "", "", 0) for i, t in enumerate(ODD)]
    rows += [(950 + i, "".join(rng.choice("aab eé\n.1😀") for _ in range(60)), "", "", 0) for i in range(20)]
    got = al.align_tokenizers(frame(spark, rows, clashing=("block", "pairs", "N_A"))).collect()
    want = brute([r[1] for r in rows], models)
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=str)
    zero = [w for r, w in zip(rows, want) if r[0] in (300, 301, 903)]
    assert all(w == (0, 0, 0, 0, 0, 0, "") for w in zero) and want[5][3] > 0


def test_long_texts_are_cut_where_no_piece_spans(monkeypatch, models):
    monkeypatch.setattr(al, "LONG", 7)
    pieces = al.Pieces(al.B_PATH)
    assert pieces.cuts
    rng = random.Random(8)
    for _ in range(500):
        t = "".join(rng.choice("ab  cé\n.") for _ in range(rng.randint(1, 60)))
        assert pieces.encode(t) == models[1].encode(t), repr(t)


def test_identity_map(models):
    ours = al.aligner(al.A_PATH, al.B_PATH)
    has = np.flatnonzero(ours.identity >= 0)
    assert len(has) > 20_000
    assert all(models[2][i] == models[3][ours.identity[i]] for i in has.tolist())
    assert not ours.b.is_byte[ours.identity[ours.a.tokenizer.token_to_id("A")]]


def test_empty_table(spark):
    assert al.align_tokenizers(frame(spark, [], DOCS)).count() == 0
