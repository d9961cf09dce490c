import math
import random
from collections import Counter

import numpy as np
import pytest

from pagetext.llm import quality
from pagetext.llm.packed import flat

from .helpers import DOCS, frame, odd_documents, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=7):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        good = i % 8 != 0
        text = prose(rng, rng.randint(20, 60))
        docs.append((i, text if good else " ".join(w + "$$$ %%%" for w in text.split(" ")), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_clean_documents_stay(spark):
    docs, labels = corpus()
    labels += [(8, None, None), (None, 1, 0), (2, 0, 0)]          # a null label, a null id, a contradiction
    got = {r["doc_id"]: r["selected"] for r in quality.resample(frame(spark, docs, clashing=("good", "text_hash")), frame(spark, labels, LABELS)).collect()}
    assert len(got) == len(docs)
    clean = [got[i] for i in got if i % 8]
    junk = [got[i] for i in got if i % 8 == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.02


def test_weights_equal_a_plain_count(spark):
    docs, labels = corpus(120)
    sample = {r["doc_id"]: (r["good"], r["calibrates"]) for r in quality.labelled_sample(frame(spark, labels, LABELS)).collect()}
    import pyarrow as pa
    feats = {i: Counter(quality.features(*flat(pa.array([t])))[0].tolist()) for i, t, *_ in docs}
    raw, target = Counter(), Counter()
    for i, f in feats.items():
        raw += f
        if sample.get(i) == (True, False):
            target += f
    n_raw, n_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    got = quality.resample(frame(spark, docs), frame(spark, labels, LABELS), k=50).collect()
    for r in got:
        want = sum(c * (math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)) for b, c in feats[r["doc_id"]].items())
        want *= quality.EXCERPT / (quality.EXCERPT + sum(feats[r["doc_id"]].values()))
        assert r["log_weight"] == pytest.approx(want, abs=1e-9)
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    assert sum(r["selected"] for r in got) == 50 and all(r["selected"] == (r["gumbel_key"] >= keys[49]) for r in got)


def test_gumbel_noise_has_its_law(spark):
    docs = frame(spark, [(i, "", "", "", 0) for i in range(4000)])
    key = np.array([r["gumbel_key"] for r in quality.resample(docs, frame(spark, [], LABELS)).collect()])
    assert key.mean() == pytest.approx(0.5772, abs=0.1) and key.std() == pytest.approx(math.pi / math.sqrt(6), abs=0.1)


def test_radix_selection(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randint(-2 ** 63, 2 ** 63 - 1), rng.randint(-5, 5)]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 77, 150, 299, 300):
        assert quality.kth_largest(df, "v", k) == ranked[k - 1]
    assert quality.kth_largest(df, "v", 301) is None
    x = np.array([-np.inf, -2.5, -0.0, 0.0, 1e-300, 3.0, np.inf])
    assert (np.diff(quality.sortable(x)) > 0).all()


def test_odd_rows_ties_and_no_labels(spark):
    rows = odd_documents()
    df = frame(spark, rows, clashing=("whole_row", "out_id", "selected"))
    assert quality.keep_selected(df, frame(spark, [], LABELS)).count() == len(rows)
    kept = quality.keep_selected(df, frame(spark, [(i, 1, 0) for i in range(60)], LABELS))
    assert kept.columns == df.columns
    got = quality.resample(df, frame(spark, [], LABELS), k=3).collect()
    twice = [r["selected"] for r in got if r["doc_id"] == 307]
    assert len(got) == len(rows) and len(set(twice)) == 1
    assert quality.resample(frame(spark, [], DOCS), frame(spark, [], LABELS)).count() == 0
    assert quality.resample(df, frame(spark, [], LABELS), k=0).where("selected").count() == 0


def test_few_labels_and_long_documents(spark):
    """Good documents of 1 to 10,000 words, some on a topic that few labelled ones share;
    300 labels, a sixth of them bad."""
    rng, docs, labels = random.Random(11), [], []
    for i in range(600):
        good, topic = i % 6 != 0, "x" if i % 10 == 1 else ""
        n = max(1, round(10 ** (4 * (i % 97) / 96))) if good else rng.randint(20, 400)
        text = " ".join(w + topic for w in prose(rng, n).split(" "))
        docs.append((i, text if good else " ".join(w + "$$$ %%%" for w in text.split(" ")), "en", "s", 0))
        if i < 300:
            labels.append((i, int(good), 0))
    got = {r["doc_id"]: r["selected"] for r in quality.resample(frame(spark, docs), frame(spark, labels, LABELS)).collect()}
    assert np.mean([got[i] for i in got if i % 6]) > 0.98
    assert np.mean([got[i] for i in got if i % 6 == 0]) < 0.03


def test_level_parts_good_from_bad():
    good, bad = np.array([-5.0, 1.0, 2.0, 3.0]), np.array([-60.0, -45.0, 2.5])
    assert quality.parting_level(good, bad, 0.002, 3.0) == -25.0
    assert quality.parting_level(good, bad[:0], 0.0, 3.0) == -8.0
    assert quality.parting_level(good, np.array([9.0]), 0.002, 3.0) == -8.0


def test_toxic_documents_are_no_target(spark):
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 1, None), (5, 1, 0), (5, 1, 1)]
    got = {r["doc_id"]: r["good"] for r in quality.labelled_sample(frame(spark, labels, LABELS)).collect()}
    assert got == {1: True, 3: False, 4: True}
