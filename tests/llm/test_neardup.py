import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetext.llm import neardup

from .helpers import DOCS, frame, odd_documents, on_disk, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def by_hand(rows, k):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs; rows of one doc_id are one document."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            same = rows[a][0] == rows[b][0]
            inter = len(sets[a] & sets[b])
            if same or (sets[a] and sets[b] and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter)):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least[find(i)] if d is not None else None, d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, tmp_path, rows, k):
    df = frame(spark, [(d, t, "", "", 0) for d, t in rows], clashing=("node", "component", "band"))
    return sorted([tuple(r) for r in neardup.near_duplicates(on_disk(spark, tmp_path, df, f"docs{k}"), k).collect()], key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_equals_all_pairs(spark, tmp_path, k):
    rows = [(r[0], r[1]) for r in odd_documents()]
    assert run(spark, tmp_path, rows, k) == by_hand(rows, k)


def test_chains_and_short_texts(spark, tmp_path, monkeypatch):
    """Chains of drifting copies (ends unlike each other) and small sets right at the limit."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng, rows = random.Random(3), []
    w = prose(rng, 200).split(" ")
    for i in range(40):
        rows.append((1000 - i, " ".join(w)))
        for _ in range(6):
            w[rng.randrange(200)] = f"x{rng.randrange(10 ** 6)}"
    for i in range(30):
        five = prose(rng, 6).split(" ")
        rows += [(2000 + 3 * i, " ".join(five)), (2001 + 3 * i, " ".join(five[:5])), (2002 + 3 * i, " ".join(five[:4]))]
    for i in range(60):                                   # one hub, edits on different places
        e = prose(random.Random(9), 150).split(" ")
        for p in rng.sample(range(150), 8):
            e[p] = f"y{i}_{p}"
        rows.append((3000 + i, " ".join(e)))
    assert run(spark, tmp_path, rows, 2) == by_hand(rows, 2)


def test_pivot_pairs_are_dealt_over_slices(spark, tmp_path, monkeypatch):
    """One large group of near copies: same result, no key with more than about its share."""
    monkeypatch.setattr(neardup, "SLICE_PAIRS", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 60] + [f"x{i}"] + base[i % 60 + 1:])) for i in range(1, 120)]
    rows = [(0, " ".join(base))] + rows + [(500, "something else entirely"), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == {i: 0 if i < 500 else i for i, _ in rows}
    pairs = spark.createDataFrame([(0, b, 32) for b in range(1, 120)], "a long, b long, slices long")
    dealt = neardup.sliced(pairs).groupBy(*neardup.PIVOT).count()
    assert dealt.count() > 20 and dealt.agg({"count": "max"}).first()[0] < 16
    whole = neardup.copied(spark.createDataFrame([(0, "set")], "a long, carried string"), pairs)
    assert whole.count() == 32
    sizes = spark.createDataFrame([(s,) for s in (2, 4, 5, 1000)], "size long").select(neardup.slices_of(F.col("size")).alias("n"))
    assert [r.n for r in sizes.collect()] == [1, 1, 2, 256]


def test_recall_at_the_limit():
    """Pairs of similarity 0.8 share a band and pass the estimate."""
    rng = np.random.default_rng(5)
    missed = 0
    for trial in range(300):
        n = int(rng.integers(5, 400)) * 5
        union = rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        cut = n // 5
        a, b = union[:n - cut // 2], union[cut - cut // 2:]
        of = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        regs = neardup.registers(of, np.concatenate([a, b]), 2)
        keys = neardup.band_keys(regs)
        est = neardup.jaccard_estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([float(len(a))]), np.array([float(len(b))]))[0]
        missed += not (keys[0] == keys[1]).any() or est < neardup.ESTIMATE_CUT
    assert missed == 0


def test_registers_and_collisions():
    assert neardup.compress(np.array([0xFFFFFFFF, 0x80000000, 1, 0], np.uint64)).tolist() == [1023, 0, 31 << 10, 32 << 10]
    rng = np.random.default_rng(6)
    n = 4000
    value = rng.integers(0, 2 ** 63, 400 * n, dtype=np.uint64) * np.uint64(2)
    regs = neardup.registers(np.repeat(np.arange(400), n), value, 400)
    rate = np.mean([(regs[i] == regs[i + 1]).mean() for i in range(0, 400, 2)])
    assert rate == pytest.approx(neardup.expected_collisions(np.array([float(n)]), np.array([float(n)]))[0], rel=0.6)


def test_drop_keeps_one_of_each_group(spark, tmp_path):
    rows = odd_documents()
    df = on_disk(spark, tmp_path, frame(spark, rows, clashing=("gone", "whole_row", "often")), "docs")
    left = neardup.drop_near_duplicates(df)
    assert left.columns == df.columns
    keep = {r[0] for r in by_hand([(r[0], r[1]) for r in rows], 5) if r[3]}
    got = [r["doc_id"] for r in left.collect()]
    assert sorted(x for x in got if x is not None) == sorted(x for x in keep if x is not None)
    assert got.count(None) == 2


def test_empty_table(spark, tmp_path):
    df = on_disk(spark, tmp_path, frame(spark, [], DOCS), "none")
    assert neardup.near_duplicates(df).count() == 0 and neardup.drop_near_duplicates(df).count() == 0


def test_unlike_texts_under_one_id(spark, tmp_path):
    """Each text keeps its links, whether the sets are of equal or unequal size."""
    rng = random.Random(11)
    for other in (300, 180):
        a, b = prose(rng, 300), prose(rng, other)
        near = lambda t, w: t.replace(t.split(" ")[7], w, 1)
        rows = [(1, a), (1, b), (2, near(a, "x")), (3, near(b, "y")), (0, near(b, "z")), (4, prose(rng, 50)), (4, ""), (5, a)]
        (tmp_path / str(other)).mkdir()
        got = run(spark, tmp_path / str(other), rows, 2)
        assert got == by_hand(rows, 2) and {r[0]: r[2] for r in got}[2] == 0
        df = frame(spark, [(d, t, "", "", 0) for d, t in rows[:-1] if d != 0])
        left = neardup.drop_near_duplicates(on_disk(spark, tmp_path / str(other), df, "stage"), 2).collect()
        assert sorted((r["doc_id"], r["text"]) for r in left) == sorted([(1, a), (1, b), (4, rows[5][1]), (4, "")])
