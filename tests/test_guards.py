import pytest
from pyspark.errors import PySparkException

from pagetext.operators import cache, evaluate

RESULT = "doc_id long, key string, result_text string, result_language string, error string"
ROWS = "key string, text string, language string, engine_name string, created_at timestamp"


def test_a_failed_row_aborts_whatever_is_read(spark):
    failed = spark.createDataFrame([(1, "a", "x", "en", None), (2, "b", None, None, "boom")], RESULT)
    for read in (lambda d: d.count(), lambda d: d.select("doc_id").collect(), lambda d: d.select("result_text").collect(), lambda d: d.groupBy().count().collect()):
        with pytest.raises(PySparkException, match="boom"):
            read(cache.process_batch(failed))
    assert [r["doc_id"] for r in cache.process_batch(failed.where("error is null")).collect()] == [1]


def test_unequal_counts_abort_whatever_is_read(spark):
    pair = "row_id long, text string"
    one, two = spark.createDataFrame([(0, "a")], pair), spark.createDataFrame([(0, "a"), (1, None)], pair)
    for p, t in ((one, two), (two, one)):
        for read in (lambda d: d.count(), lambda d: d.select("row_id").collect(), lambda d: d.select("hyp").collect()):
            with pytest.raises(PySparkException, match="no partner"):
                read(evaluate.pair_eval(p, t))
    assert sorted(map(tuple, evaluate.pair_eval(two, two).collect()), key=str) == [(0, "a", "a"), (1, None, None)]


def rows(spark, *texts, when=None):
    return spark.createDataFrame([("k", t, "en", "e", when) for t in texts], ROWS)


def test_one_row_per_key_without_a_time(spark):
    import datetime as dt
    old = dt.datetime(1990, 1, 1)
    for r in (rows(spark, "a", "b"), rows(spark, "b", "a"), rows(spark, "a", "a", "b")):
        assert cache.latest_per_key(r).count() == 1
    assert {cache.latest_per_key(r).first()["text"] for r in (rows(spark, "a", "b"), rows(spark, "b", "a"))}.__len__() == 1
    assert cache.latest_per_key(rows(spark, "a", "b").unionByName(rows(spark, "timed", when=old))).first()["text"] == "timed"


def test_a_version_replaces_as_a_whole(spark, tmp_path):
    t = cache.VersionedTable(spark, str(tmp_path / "cache"))
    assert t.current() == 0
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.replace(rows(spark, "first"), 0) == 1
    held = t.read()
    assert t.upsert(rows(spark, "newer", when=__import__("datetime").datetime(2024, 1, 1))) == 2
    assert held.first()["text"] == "first" and t.read().first()["text"] == "newer" and t.read(1).first()["text"] == "first"


def test_of_two_writers_one_loses(spark, tmp_path, monkeypatch):
    a, b = (cache.VersionedTable(spark, str(tmp_path / "cache")) for _ in range(2))
    a.replace(rows(spark, "first"), 0)
    start = b.current()
    a.replace(rows(spark, "a"), start)
    with pytest.raises(cache.StaleWrite):
        b.replace(rows(spark, "b"), start)
    monkeypatch.setattr(b, "current", lambda: start)      # both looked before either wrote
    with pytest.raises(cache.StaleWrite):
        b.replace(rows(spark, "b"), start)
    assert a.read().first()["text"] == "a" and a.current() == 2
