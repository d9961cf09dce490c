import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagetext.llm import mixing, sharding

from .helpers import DOCS, frame, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3.0):
    """Round by round: share by weight, fix what is above its cap, share the rest again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] > cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def test_mixing_targets_and_copies(spark):
    rows = odd_documents()
    got = mixing.mixing_plan(frame(spark, rows, clashing=("Size", "rate", "whole_row"))).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, _, source, _ in rows:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    want = targets_by_hand(size)
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        rate = want[r["source"]] / size[r["source"]]
        assert r["copies"] in (int(rate + 1e-9), int(rate + 1e-9) + 1) and r["copies"] <= 3
    assert sum(want.values()) == pytest.approx(sum(size.values()))


def test_mixed_rows_follow_the_plan(spark):
    df = frame(spark, odd_documents(), clashing=("copies", "copy_no", "whole_row"))
    plan = Counter()
    for r in mixing.mixing_plan(df.drop("copies")).collect():
        plan[r["doc_id"], r["text"]] += r["copies"]
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == +plan


def test_mix_reaches_targets_of_large_sources(spark):
    rows = [(i, "w " * (1 + i % 5), "en", f"s{i % 3}" if i % 2 else "hot", 0) for i in range(6000)]
    got = mixing.mixing_plan(frame(spark, rows)).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r["n"] / r["t"] - 1) < 0.1 for r in got)


def test_empty_tables(spark):
    empty = frame(spark, [], DOCS)
    assert mixing.mix(empty).count() == 0 and mixing.mixing_plan(empty).count() == 0
    assert sharding.shuffle_into_shards(empty, 4).count() == 0


def test_shards_are_whole_gapless_and_repeatable(spark, tmp_path):
    rows = odd_documents()
    df = frame(spark, rows, clashing=("bucket", "Slot", "row_tie"))
    out = sharding.shuffle_into_shards(df, 5, bucket_bytes=2000)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "bucket", "row_tie", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shuffle_into_shards(df.repartition(7), 5, bucket_bytes=2000).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    grown = {r["doc_id"]: r["shard"] for r in sharding.shuffle_into_shards(df, 6).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in got)
    sharding.write_shards(out.select("doc_id", "text", "shard", "slot"), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_buckets_are_shuffled(spark):
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(500)]
    got = sorted((r["slot"], r["doc_id"]) for r in sharding.shuffle_into_shards(frame(spark, rows), 1).collect())
    ids = [i for _, i in got]
    assert sorted(ids) == list(range(500)) and ids != sorted(ids)


def test_row_sizes_count_bytes(spark):
    got = frame(spark, odd_documents()).select("text", sharding.row_size().alias("n"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c")).collect()
    for r in got:
        b = (r["text"] or "").encode()
        assert (r["n"], r["c"]) == (len(b) + 16, zlib.crc32(b))


def test_rows_that_share_an_id_decide_apart(spark):
    # two thirds without an id; unlike texts, and one text a thousand times
    rows = [(None if i % 3 else i, f"a b c d e{i}", "en", f"s{i % 2}", 0) for i in range(6000)] + [(7, "v w x y z", "en", "s0", 0)] * 3000
    df = frame(spark, rows)
    plan = mixing.mixing_plan(df)
    for r in plan.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect():
        assert abs(r["n"] / r["t"] - 1) < 0.05
    columns = ["doc_id", "source", "text", "copies"]
    again = mixing.mixing_plan(df.repartition(5)).select(*columns)
    assert Counter(map(tuple, plan.select(*columns).collect())) == Counter(map(tuple, again.collect()))


def test_repeats_are_numbered_in_chunks(spark, monkeypatch):
    from pagetext.llm import tables
    monkeypatch.setattr(tables, "NUMBERED_ROWS", 10)
    df = spark.createDataFrame([(1, None)] * 57 + [(None, "x")] * 23 + [(2, "y")], "a long, b string")
    repeats = df.groupBy("a", "b").count().where("count > 1").withColumnRenamed("count", "n")
    got = defaultdict(list)
    for r in tables.numbered_repeats(df, repeats, ["a", "b"], "number").collect():
        got[r["a"], r["b"]].append(r["number"])
    assert {k: sorted(v) for k, v in got.items()} == {(1, None): [*range(57)], (None, "x"): [*range(23)], (2, "y"): [0]}


def test_equal_rows_fill_several_buckets(spark):
    rows = [(None, "same text", "en", "s", 0)] * 400 + [(i, f"text {i}", "en", "s", 0) for i in range(50)]
    df = frame(spark, rows)
    got = sharding.shuffle_into_shards(df, 3, bucket_bytes=1000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shuffle_into_shards(df.repartition(7), 3, bucket_bytes=1000).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
