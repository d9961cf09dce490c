import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagetext.llm import bytebpe, tokenfile as tf

from .helpers import DOCS, frame, odd_documents

ODD = ["<|endoftext|>", "a  <|endoftext|>  b", "  two  blanks ", "\n\n x\n", "don't  'we'll'sx ''s", "՘ \U0001c801 new 日本語 ñ\x00😀", "x" * 5000,
       " ", "   z\u0085 \x1c q", "1234567 ٣٤", "<|endoftext", "tab\t\tend  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tf.TOKENIZER)


@pytest.mark.parametrize("specials", [True, False])
def test_ids_equal_the_library(library, specials):
    own = Tokenizer.from_file(tf.TOKENIZER)
    own.encode_special_tokens = not specials
    bpe = bytebpe.ByteBpe(tf.TOKENIZER, specials)
    rng = random.Random(4)
    alphabet = "ab 's'tLé\n\t0٣.,<|> ​日😀́՘"
    texts = ODD + [r[1] or "" for r in odd_documents()] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), bpe.dtype).tolist() == own.encode(t, add_special_tokens=False).ids, t
    assert b"".join(bpe.bytes_of[i] for i in np.frombuffer(bpe.encode("Été 日本"), bpe.dtype)) == "Été 日本".encode()


PARTS = ["ab", " ", " ", "  ", "'s", "'t", "'re", "'r", "'ve", "'ll", "'l", "'", "'d", "'m", "L", "é", "\n", "\t", "0", "²", ".", "\x85", "\xa0",
         "\x1c", "\0", "ɏ", "×", "e", "l", "s"]
FAR_PARTS = ["ɐ", "日", "٣", "①", "𝟘", "𐐀", "\u0301", "\u200b", "\u3000", "\u2003", "\u2028", "\u1680", "\u180e", "\ufeff", "😀", "’", "—", "…", "ſ"]
ALONE_PARTS = ["՘", "\U000e0fff", "\uffff", "<|endoftext|>", "<|endof", "text|>"]


@pytest.mark.parametrize("specials", [True, False])
def test_ids_of_a_batch_equal_the_library(library, specials):
    own = Tokenizer.from_file(tf.TOKENIZER)
    own.encode_special_tokens = not specials
    bpe = bytebpe.ByteBpe(tf.TOKENIZER, specials)
    rng = random.Random(7)
    texts = ODD + [r[1] for r in odd_documents()] + ["", None]
    for i in range(4000):
        parts = PARTS + FAR_PARTS * (i % 3 > 0) + ALONE_PARTS * (i % 10 == 0)
        texts.append("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))))
    whole, end = pa.array(texts), bpe.packed([0])
    want = [np.array(own.encode(t or "", add_special_tokens=False).ids + [0], bpe.dtype).tobytes() for t in texts]
    for size in (1, 7, len(texts)):
        got = [ids for at in range(0, len(texts), size) for ids in bpe.encode_all(whole.slice(at, size), end).to_pylist()]
        assert [(t, g) for t, g, w in zip(texts, got, want) if g != w] == []
    assert bpe.encode_all(pa.array([None, ""], pa.string())).to_pylist() == [b"", b""]


def test_far_characters_do_not_part_a_text_from_its_batch(monkeypatch):
    bpe = bytebpe.ByteBpe(tf.TOKENIZER, True)
    texts = ["it’s a “word” — and … 日本語 \u3000 😀", "nearer", "ɐ٣ \u2003 \u2003x"] * 3
    want = [bpe.encode(t) for t in texts]
    monkeypatch.delattr(bytebpe.ByteBpe, "encode")
    assert bpe.encode_all(pa.array(texts)).to_pylist() == want


def test_a_word_is_looked_up_once_in_a_batch():
    asked = []

    class Counted(bytebpe.ByteBpe):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)
    bpe = Counted(tf.TOKENIZER, True)
    bpe.encode_all(pa.array(["one two one two", "one two", None, " two"] * 50), bpe.packed([0]))
    assert sorted(asked) == [" one", " two", "one"]


def test_id_counts(spark):
    rows = [(np.array(ids, "<u2").tobytes(),) for ids in ([3], [], [3, 5, 3], list(range(10)) * 40_000)]
    counts = tf.id_counts(spark.createDataFrame(rows, "ids binary"), 12, np.dtype("<u2"))
    want = np.array([40_000] * 10 + [0, 0])
    want[[3, 5]] += (3, 1)
    assert counts.tolist() == want.tolist()


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMORY", 2000)
    bpe = bytebpe.ByteBpe(tf.TOKENIZER, False)
    text = " ".join(f"w{i}q" for i in range(500)) + " " + "y" * 100
    whole = bpe.encode(text)
    assert len(bpe) < 20 and bpe.encode(text) == whole and " " + "y" * 100 not in bpe


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def limited_cost(counts, limit):
    """Least cost over all length assignments that Kraft's inequality allows (small alphabets)."""
    counts, best = sorted((c for c in counts if c), reverse=True), [None]

    def go(i, low, room, cost):
        if i == len(counts):
            best[0] = cost if best[0] is None else min(best[0], cost)
            return
        for bits in range(low, limit + 1):
            if room >= 1 << (limit - bits):
                go(i + 1, bits, room - (1 << (limit - bits)), cost + bits * counts[i])
    go(0, 1, 1 << limit, 0)
    return best[0]


def test_code_lengths_are_optimal():
    rng = random.Random(5)
    for _ in range(40):
        counts = np.array([rng.choice((0, 1, 2, 5, 40, 1000)) for _ in range(rng.randint(2, 9))])
        if (counts > 0).sum() < 2:
            continue
        for limit in (4, 5, 18):
            bits = tf.code_lengths(counts, limit)
            assert bits.max() <= limit and (bits[counts == 0] == 0).all()
            want = huffman_cost(counts.tolist()) if limit == 18 else limited_cost(counts.tolist(), limit)
            assert int((bits * counts).sum()) == want
    assert tf.code_lengths(np.array([0, 0, 7])).tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        tf.code_lengths(np.ones(9), 3)


def test_blocks_round_trip():
    rng = np.random.default_rng(6)
    counts = np.concatenate([np.full(5, 10 ** 6), np.arange(1, 3000), [0]])
    book = tf.Codebook(tf.code_lengths(counts))
    for n in (1, 2, tf.LANE - 1, tf.LANE, tf.LANE + 1, 10 * tf.LANE, 5001):
        ids = rng.choice(len(counts) - 1, n).astype(np.uint16)
        assert (book.decode(*book.encode(ids), n) == ids).all()
    with pytest.raises(KeyError):
        book.encode(np.array([len(counts) - 1]))


def test_crc_of_pieces():
    a, b = b"first piece", b"and the second" * 99
    assert tf.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert tf.crc_joined(0, zlib.crc32(a), len(a)) == zlib.crc32(a) and tf.crc_joined(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.mark.parametrize("block", [100, 1 << 17])
def test_files_hold_the_ids_in_order(spark, library, tmp_path, monkeypatch, block):
    monkeypatch.setattr(tf, "BLOCK", block)
    rows = odd_documents() + [(900 + i, t, "", "", 0) for i, t in enumerate(ODD)]
    rows += [(None, None, "en", "x", 0)] * 30
    folder = str(tmp_path / "files")
    tf.write_token_file(frame(spark, rows, clashing=("part", "ids", "Row")), folder)
    got = tf.document_digests(spark, folder).collect()
    want, at = [], 0
    ids = {t: library.encode(t, add_special_tokens=False).ids + [0] for t in {r[1] or "" for r in rows}}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((r[0], len(ids[r[1] or ""]), zlib.crc32(np.array(ids[r[1] or ""], "<u4").tobytes())))
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert sorted(((g[0], g[2], g[3]) for g in got), key=str) == sorted(want, key=str)
    for g in got:
        assert g[1] == at
        at += g[2]
    assert [g[0] or 0 for g in got] == [w[0] or 0 for w in want]
    pieces = tf.read_token_file(spark, folder).orderBy("part", "row", "offset").collect()
    texts = {}
    for p in pieces:
        texts.setdefault((p["part"], p["row"], p["doc_id"]), []).extend(p["ids"])
    assert sorted((str(k[2]), v) for k, v in texts.items()) == sorted((str(r[0]), ids[r[1] or ""]) for r in rows)
    bits = spark.read.parquet(f"{folder}/codebook").agg({"bits": "max"}).first()[0]
    assert bits <= tf.MAX_BITS


def test_empty_table(spark):
    assert tf.token_file_digests(frame(spark, [], DOCS)).count() == 0
