import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagetext.llm import ctw

from .helpers import DOCS, frame, odd_documents, on_disk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class Tree:
    """Context-tree weighting as the papers write it: one recursive tree per node of the byte."""

    def __init__(self, texts, depth=ctw.DEPTH):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            for context, symbol in self.symbols(t):
                for k in range(8):
                    node, bit = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1
                    for d in range(depth + 1):
                        self.counts[node, context[:d]][bit] += 1
        self.children = defaultdict(set)
        for node, c in list(self.counts):
            if c:
                self.children[node, c[:-1]].add(c)
        self.pw = {}
        for node, c in sorted(self.counts, key=lambda x: -len(x[1])):
            pe = self.pe(node, c)
            if len(c) == depth:
                self.pw[node, c] = pe
            else:
                kids = sum(self.pw[node, x] for x in self.children[node, c])
                self.pw[node, c] = max(pe, kids) + math.log1p(math.exp(-abs(pe - kids))) - math.log(2)

    def symbols(self, text):
        """(context, most recent byte first; symbol) of each byte and the end mark."""
        b = bytes([0xFF] * self.depth) + text.encode() + b"\xff"
        return [(tuple(b[i - 1 - j] for j in range(self.depth)), b[i]) for i in range(self.depth, len(b))]

    def pe(self, node, c):
        a, b = self.counts[node, c]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def one(self, node, context, d=0):
        c = context[:d]
        if (node, c) not in self.pw:
            return 0.5
        a, b = self.counts[node, c]
        kt = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return kt
        w = math.exp(self.pe(node, c) - math.log(2) - self.pw[node, c])
        return w * kt + (1 - w) * self.one(node, context, d + 1)

    def log10(self, text):
        total = 0.0
        for context, symbol in self.symbols(text):
            for k in range(8):
                p = self.one((1 << k) | (symbol >> (8 - k)), context)
                total += math.log10(p if (symbol >> (7 - k)) & 1 else 1 - p)
        return total


def test_scores_equal_a_plain_tree(spark, tmp_path):
    rows = [r for r in odd_documents(n=40) if r[0] != 306]
    df = on_disk(spark, tmp_path, frame(spark, rows, clashing=("block", "gram", "word")), "docs")
    got = ctw.score_texts(df).collect()
    assert len(got) == len(rows)
    train = [r[1] or "" for r in rows if not held(r[0])]
    tree = Tree(train)
    counts = Counter(w for t in train for w in WORD.findall(t.translate(LOWER)))
    counts["<end>"] = len(train)
    total, kinds = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, t, *_ in rows:
        tokens = [*WORD.findall((t or "").translate(LOWER)), "<end>"]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        want[i].append((held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, tree.log10(t or "")))
    for r in got:
        w = want[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert r["score"] == pytest.approx(w[5], rel=1e-9)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3, 1e7])
    assert ctw.log_gamma(x.copy()) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_model_learns_and_probabilities_sum_to_one(spark, tmp_path):
    tree = Tree(["abracadabra", "abra"])
    for context in ((0x61, 0x72, 0x62, 0x61), (1, 2, 3, 4)):
        total = sum(10 ** sum(math.log10(p if (s >> (7 - k)) & 1 else 1 - p) for k in range(8)
                              for p in [tree.one((1 << k) | (s >> (8 - k)), context)]) for s in range(256))
        assert total == pytest.approx(1.0)


def test_empty_and_untrained_tables(spark, tmp_path):
    assert ctw.score_texts(on_disk(spark, tmp_path, frame(spark, [], DOCS), "none")).count() == 0
    out = next(i for i in range(100) if held(i))
    got = ctw.score_texts(on_disk(spark, tmp_path, frame(spark, [(out, "a b", "", "", 3)]), "one")).collect()
    assert got[0]["train_tokens"] == 0 and got[0]["n_known"] == 0
    assert got[0]["score"] == pytest.approx(-4 * 8 * math.log10(2)) and got[0]["base_score"] == pytest.approx(0.0)


def test_lookup_resolves_shared_slots():
    keys = np.arange(1, 5000, dtype=np.uint64) * np.uint64(1 << 40)
    table = ctw.Lookup(keys, np.arange(4999.0))
    assert (table(keys[::-1]) == np.arange(4999.0)[::-1]).all()


def test_lookup_raises_for_a_missing_key():
    keys = np.arange(1, 500, dtype=np.uint64) * np.uint64(1 << 40)
    table = ctw.Lookup(keys, np.arange(499.0))
    for missing in (0, 7, 2 ** 64 - 1):
        with pytest.raises(KeyError):
            table(np.array([1 << 40, missing], dtype=np.uint64))
    with pytest.raises(KeyError):
        ctw.Lookup(keys[:0], np.zeros(0))(keys)


def test_scores_stay_when_file_splits_change_between_the_scans(spark, tmp_path, monkeypatch):
    df = on_disk(spark, tmp_path, frame(spark, odd_documents(n=40)), "docs")
    rows = lambda: sorted(map(str, ctw.score_texts(df).select("doc_id", "n_tokens", "n_known", "base_score", "bits_per_byte").collect()))
    want, plain = rows(), ctw.gram_scores

    def resized(counts):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        return plain(counts)
    monkeypatch.setattr(ctw, "gram_scores", resized)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_blocks_are_bounded_and_do_not_change_the_scores(spark, tmp_path, monkeypatch):
    rows = odd_documents(n=40)
    df = frame(spark, rows).coalesce(1)
    score = lambda: sorted((str(r["doc_id"]), r["n_known"], round(r["score"], 6)) for r in ctw.score_texts(df).collect())
    want = score()
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 1000)
    sizes = Counter()
    for r in ctw.in_blocks(df).collect():
        sizes[r["block"]] += len((r["text"] or "").encode()) + ctw.ROW_BYTES
    longest = max(len((t or "").encode()) for _, t, *_ in rows)
    assert len(sizes) > 10 and max(sizes.values()) <= 1000 + longest + ctw.ROW_BYTES and score() == want
