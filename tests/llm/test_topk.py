import math
import random

from pagetext.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, k=5, every=50):
    ok = [(n, i, [math.floor(256 * float(x)) for x in v]) for n, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, x in ok:
        if q is None or q % every:
            continue
        score = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0, m, i) for m, i, y in ok if m != n and len(y) == len(x)]
        for rank, s in enumerate(sorted(score, key=lambda t: t[:4])[:k], 1):
            out.append((q, rank, s[4], -s[0]))
    return sorted(out, key=repr)


def single(x):
    import numpy as np
    return float(np.float32(x))


def vectors(n, dim, seed, scale=lambda r: 1.0):
    r = random.Random(seed)
    return [(i, [single(r.gauss(0, 1) * scale(r)) for _ in range(dim)]) for i in range(n)]


def run(spark, rows, monkeypatch=None, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in topk.top_k(df, **kw).collect()], key=repr)


def test_equals_brute_force_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rows = vectors(700, 24, 1, scale=lambda r: 1.0) + [(1000 + i, [single(x * 3) for x in v]) for i, v in vectors(60, 24, 2)]
    assert run(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    base = vectors(120, 3, 3)
    same = base[10][1]
    rows = base + [(200 + i, same) for i in range(30)] + [(50, base[50][1]), (50, base[50][1]), (None, same), (300, None), (350, [1.0, None, 2.0]),
                                                          (400, [float("nan"), 0.0, 0.0]), (450, [float("inf"), 0.0, 0.0]), (500, [1.0, 2.0]), (501, [3.0, -1.0]),
                                                          (550, []), (551, [])]
    assert run(spark, rows) == by_hand(rows)


def test_large_components_stay_exact(spark):
    r = random.Random(4)
    rows = [(i, [single(r.uniform(-1, 1) * 2 ** 20) for _ in range(8)]) for i in range(60)]
    assert run(spark, rows) == by_hand(rows)


def test_fewer_rows_than_k_and_empty(spark):
    rows = vectors(3, 4, 5)
    assert run(spark, rows) == by_hand(rows) and len(run(spark, rows)) == 2
    assert run(spark, []) == []
