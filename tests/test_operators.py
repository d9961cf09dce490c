from pyspark.sql import functions as F

from pagetext.functions.edit_distance import levenshtein
from pagetext.operators import attempts, cache, evaluate, flatten, pages
from pagetext.plans import catalog


def test_cer_wer_against_brute_force(spark):
    pairs = [(1, "the cat sat", "the bat sat"), (2, "", "abc"), (3, "a b c d", "a c d"), (4, "same", "same")]
    df = spark.createDataFrame(pairs, "row_id long, ref string, hyp string")
    got = {r.row_id: (r.cer, r.wer) for r in evaluate.score_pairs(df).collect()}
    for rid, ref, hyp in pairs:
        cer = levenshtein(ref, hyp) / max(1, len(ref))
        wer = levenshtein(ref.split(), hyp.split()) / max(1, len(ref.split()))
        assert abs(got[rid][0] - cer) < 1e-12 and abs(got[rid][1] - wer) < 1e-12


def test_first_success(spark):
    rows = [(1, 0, "", 5.0), (1, 1, "", 7.0), (1, 2, "ok", 11.0), (2, 0, "a", 3.0), (2, 1, "b", 4.0),
            (3, 0, "", 1.0), (3, 1, "", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, text string, ms double")
    got = {r.doc_id: (r.winner, r.text, r.duration_ms) for r in attempts.first_success(df).collect()}
    assert got == {1: (2, "ok", 16.0), 2: (0, "a", 3.0), 3: (0, "", 1.0)}


def test_merge_page_text(spark):
    assert pages.OCR_SEPARATOR == "\n--- OCR ---\n"
    df = spark.createDataFrame([("o", "e"), ("", "e"), ("o", "")], "ocr string, pdf string")
    got = [r.t for r in df.select(pages.merge_text_safe(F.col("ocr"), F.col("pdf")).alias("t")).collect()]
    assert got == ["e\n--- OCR ---\no", "e", "o"]


def test_cache_round_trip_and_dummy(spark):
    inputs = spark.createDataFrame([(1, "data"), (2, "data"), (3, "other")], "doc_id long, text string") \
        .withColumn("key", cache.content_key(F.col("text")))
    stored = spark.createDataFrame(
        [(cache_key, "hello", None, "paddle")
         for cache_key in [inputs.where("doc_id = 1").first().key]]
        + [(inputs.where("doc_id = 3").first().key, "dummy-ocr-output", "en", "dummy")],
        "key string, text string, language string, engine_name string").withColumn(
        "created_at", F.current_timestamp())
    hits = {r.doc_id: (r.cached_text, r.cached_language) for r in cache.cache_hits(inputs, stored).collect()}
    assert hits == {1: ("hello", "mix"), 2: ("hello", "mix")}
    assert [r.doc_id for r in cache.cache_misses(inputs, stored).collect()] == [3]


def test_flatten_numbering(spark):
    import json
    quad = [[0, 0], [1, 1]]
    payload = [[[quad, ["a", 0.9]], [quad, ["low", 0.1]], [quad, ["b", 0.8]]], [[quad, ["gone", 0.2]]],
               [[quad, ["c", 0.7]]]]
    df = spark.createDataFrame([(1, json.dumps(payload))], "doc_id long, j string")
    lines = flatten.extract_lines(df)
    got = sorted((r.block_id, r.line_id, r.text) for r in lines.collect())
    # the filtered-out page still consumes block id 1
    assert got == [(0, 0, "a"), (0, 1, "b"), (2, 0, "c")]


def test_queries_small(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("response_struct", "latency_report", "cache_get_or_set", "best_rotation", "spell_candidates"):
        assert catalog.QUERIES[name](spark, sf).count() > 0


QUAD = [[0, 0], [1, 0], [1, 1], [0, 1]]


def walked(spark, payloads, **kw):
    import json
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return flatten.Walked(spark.createDataFrame(rows, "doc_id long, j string"), **kw)


def test_payload_shapes_and_key_spellings(spark):
    shapes = [[[[QUAD, ["hello", 0.99]]]], [[[QUAD, ["triplet", 0.88], {"extra": True}]]], [[{"bbox": QUAD, "text": "dict", "score": 0.92}]],
              [{"res": [{"line": {"points": QUAD, "content": "nested", "confidence": 0.87}}]}], {"data": [{"box": QUAD, "text": "data", "score": 0.91}]},
              [[{"box": {"polygon": QUAD}, "label": "inner box", "prob": 0.5}]], [[{"position": QUAD, "transcription": "listed", "score": [0.6]}]],
              [[{"poly": QUAD, "value": "objects", "score": {"probability": 0.7}}]], [[[QUAD, {"value": "info", "confidence": 0.8}]]],
              [[[QUAD, "bare"]]], [[[QUAD, ["", 0.9], ["third", 0.4]]]], [[{"line": {"line": {"bbox": QUAD, "text": "twice"}}}]], [[{"bbox": QUAD, "text": "z", "score": 0}]]]
    got = {r["doc_id"]: r for r in walked(spark, shapes).lines().collect()}
    texts = ["hello", "triplet", "dict", "nested", "data", "inner box", "listed", "objects", "info", "bare", "third", "twice", "z"]
    scores = [0.99, 0.88, 0.92, 0.87, 0.91, 0.5, 0.6, 0.7, 0.8, 1.0, 0.4, 1.0, 1.0]
    assert [got[i]["text"] for i in range(13)] == texts
    assert [got[i]["confidence"] for i in range(13)] == scores
    assert all(got[i]["bbox"] == [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0] for i in range(13))


def test_pages_are_not_taken_for_entries(spark):
    w = walked(spark, [[[[QUAD, ["a", 0.9]], [QUAD, ["b", 0.8]]], [[QUAD, ["c", 0.7]]]]])
    assert sorted((r["page"], r["pos"], r["text"]) for r in w.page_lines.collect()) == [([0], 0, "a"), ([0], 1, "b"), ([1], 0, "c")]


def test_fallback_finds_entries_anywhere(spark):
    w = walked(spark, [{"output": {"lines": [{"bbox": QUAD, "text": "a"}, {"bbox": QUAD, "text": "b", "score": 0.1}, {"bbox": QUAD, "text": "c"}]}}])
    assert sorted((r["block_id"], r["line_id"], r["text"], r["mode"]) for r in w.lines().collect()) == [(0, 0, "a", "fallback"), (1, 0, "c", "fallback")]


def test_every_payload_gives_a_document(spark):
    deep = "[" * 70 + "]" * 70
    entry = '[[[[0,0],[1,1]],["x",0.9]]]'
    w = walked(spark, ["[[]]", "{bad", deep, "[" * 100_000 + "]" * 100_000, None, "null", "5", "[" * 70 + entry + "]" * 70, "[[[" + entry + "]]]"])
    docs = {r["doc_id"]: (r["text"], len(r["blocks"]), r["reject"]) for r in w.documents().collect()}
    assert docs == {0: ("", 0, None), 1: ("", 0, flatten.INVALID), 2: ("", 0, flatten.TOO_DEEP), 3: ("", 0, flatten.INVALID), 4: ("", 0, flatten.INVALID),
                    5: ("", 0, None), 6: ("", 0, None), 7: ("", 0, flatten.TOO_DEEP), 8: ("x", 1, None)}


def test_latest_row_does_not_depend_on_the_order(spark):
    rows = [("k", "t1", "en", "a", "2024-01-01"), ("k", "t2", "id", "b", "2024-01-01"), ("k", "t0", "en", "a", "2023-01-01"), ("k", "t1", "en", "a", "2024-01-01")]
    make = lambda r: spark.createDataFrame(r, "key string, text string, language string, engine_name string, d string").selectExpr(
        "key", "text", "language", "engine_name", "cast(d as timestamp) as created_at")
    one, two = cache.latest_per_key(make(rows)).collect(), cache.latest_per_key(make(rows[::-1])).collect()
    assert one == two and len(one) == 1 and one[0]["text"] in ("t1", "t2")


def test_warm_cache_keeps_going_where_a_batch_aborts(spark):
    import pytest
    inputs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "bad"), (4, "known")], "doc_id long, text string").withColumn("key", cache.content_key(F.col("text")))
    known = inputs.where("doc_id = 4").selectExpr("key", "'old' as text", "'id' as language", "'paddle' as engine_name", "timestamp'2024-01-01' as created_at")

    def compute(df):
        return df.select("key", F.upper("text").alias("text"), F.lit("en").alias("language"), F.lit("x").alias("engine_name"),
                         F.when(F.col("text") == "bad", F.lit("broken")).alias("error"))
    results, new = cache.get_or_set(inputs, known, compute)
    assert {r["doc_id"]: (r["result_text"], r["from_cache"], r["error"]) for r in results.collect()} == {
        1: ("GOOD", False, None), 2: ("BAD", False, "broken"), 3: ("BAD", False, "broken"), 4: ("old", True, None)}
    assert sorted(r["text"] for r in new.collect()) == ["GOOD", "old"]
    assert sorted(r["status"] for r in cache.warm_cache(results).collect()) == ["failed", "ok", "ok"]
    with pytest.raises(Exception, match="batch item failed: broken"):
        cache.process_batch(results).collect()


def test_plan_of_get_or_set_has_no_sort_aggregate(spark):
    inputs = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("key", cache.content_key(F.col("text")))
    known = inputs.selectExpr("key", "text", "'id' as language", "'paddle' as engine_name", "timestamp'2024-01-01' as created_at")
    results, _ = cache.get_or_set(inputs, known, catalog._compute)
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Scan") <= 3
    plan = attempts.first_success(spark.createDataFrame([(1, 0, "a", 1.0)], "doc_id long, ord int, text string, ms double"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_page_limit_is_a_parameter(spark):
    p = spark.createDataFrame([("a", i, None) for i in range(7)], "pdf string, page_index int, embedded_text string")
    assert pages.page_table(p).count() == 7 and pages.page_table(p, max_pages=5).count() == 5


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    from pagetext.streaming.ingest import read_store, stream_ingest
    from pagetext.streaming.metrics import read_metrics, stream_metrics
    src, store, ckpt = (str(tmp_path / x) for x in ("src", "store", "ckpt"))
    docs = lambda ids: spark.createDataFrame([(i, f"text {i % 5}") for i in ids], "doc_id long, text string")
    docs(range(8)).write.parquet(src)
    for _ in range(2):
        stream_ingest(spark, src, "doc_id long, text string", store, ckpt)
    assert read_store(spark, store).count() == 5
    import os
    assert len([f for f in os.listdir(os.path.join(ckpt, "commits")) if f.isdigit()]) == 1      # the second start read nothing
    docs(range(8)).unionByName(spark.createDataFrame([(9, "new")], "doc_id long, text string")).write.mode("append").parquet(src)
    stream_ingest(spark, src, "doc_id long, text string", store, ckpt)
    assert read_store(spark, store).count() == 6
    ev, out, ck2 = (str(tmp_path / x) for x in ("ev", "out", "ck2"))
    spark.createDataFrame([("a", 2.0), ("a", 300.0)], "event_type string, value double").write.parquet(ev)
    stream_metrics(spark, ev, "event_type string, value double", out, ck2)
    spark.createDataFrame([("a", 1.0)], "event_type string, value double").write.mode("append").parquet(ev)
    stream_metrics(spark, ev, "event_type string, value double", out, ck2)
    assert read_metrics(spark, out).where("le = '+Inf'").collect()[0]["bucket_count"] == 3


def test_engine_errors_are_rows(spark):
    from pagetext.operators import engine
    df = spark.createDataFrame([("a", b'{"data":[{"box":[[0]],"text":"x"}]}'), ("b", b"{"), ("c", b'[[[[0,0]],["y",1]]]')], "key string, content binary")
    got = {r["key"]: (r["text"], r["error"]) for r in engine.run_engine(df, engine.JsonPayloadEngine, ("en",), name="replay").collect()}
    assert got == {"a": ("x", None), "b": (None, "ValueError: payload is no JSON"), "c": ("y", None)}


def test_cluster_session_needs_a_shared_folder():
    import pytest

    from pagetext.session import shared_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://head:7077"
            getCheckpointDir = staticmethod(lambda: None)
    with pytest.raises(ValueError):
        shared_dir(Cluster())


def test_one_walk_serves_pages_and_fallback(spark):
    """Shapes mixed within one payload, wrappers several deep, container keys beside each other, a page line that is no entry."""
    entry = lambda t, s=0.9: {"bbox": QUAD, "text": t, "score": s}
    mixed = {"pages": [[QUAD, ["b", 0.9]]], "res": [{"line": {"line": {"line": entry("a")}}}, {"box": QUAD}], "other": [entry("only in the fallback")]}
    w = walked(spark, [[mixed, [[entry("c")], entry("d")]], [[[QUAD, ["low", 0.1]], [[entry("inside")]]]], {"x": {"y": [entry("z")]}}])
    lines = {(r["doc_id"], r["block_id"], r["line_id"]): (r["text"], r["mode"]) for r in w.lines().collect()}
    assert {t for (d, _, _), t in lines.items() if d == 0} == {("a", "pages"), ("b", "pages"), ("c", "pages"), ("d", "pages")}
    assert [lines[0, b, 0][0] for b in range(3)] == ["a", "b", "c"]
    assert {t for (d, _, _), t in lines.items() if d == 1} == {("inside", "fallback")}
    assert {t for (d, _, _), t in lines.items() if d == 2} == {("z", "fallback")}


def test_levels_and_wrappers_beyond_one_plan(spark):
    deep, wrapped = {"bbox": QUAD, "text": "x"}, {"bbox": QUAD, "text": "w"}
    for _ in range(20):
        deep = [[deep]]
    for _ in range(9):
        wrapped = {"line": wrapped}   # the page's first element, so the list beside it is a line without text
    w = walked(spark, [deep, [wrapped, [{"bbox": QUAD, "text": "v"}]]], max_levels=65)
    assert sorted((r["doc_id"], r["text"], r["mode"]) for r in w.lines().collect()) == [(0, "x", "pages"), (1, "w", "pages")]
    assert walked(spark, [deep], max_levels=10).rejects.count() == 1


def test_ingest_writes_one_file_a_prefix(spark, tmp_path):
    from pagetext.streaming.ingest import stream_ingest
    src, store = str(tmp_path / "src"), tmp_path / "store"
    spark.range(600).selectExpr("id AS doc_id", "concat('text ', id % 300) AS text").repartition(4).write.parquet(src)
    stream_ingest(spark, src, "doc_id long, text string", str(store), str(tmp_path / "ckpt"))
    files = [len(list(p.glob("*.parquet"))) for p in store.glob("prefix=*")]
    assert files and max(files) == 1
    rows = spark.read.parquet(str(store)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300))


def test_payload_fixture_merges_rows_of_one_document(spark, tmp_path):
    from pagetext.plans import fixtures as fx
    rows = [(3, "a\nb\nc\nd\ne", "en"), (9, "a\nb", "en"), (9, "c", "en"), (4, "", "en"), (8, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    df = fx.fx_engine_json(spark, str(tmp_path))
    got = {r["doc_id"]: r["j"] for r in df.collect()}
    import json
    texts = lambda p: [next(v for k, v in e.items() if k in fx.TEXT_SPELLINGS) for e in p]
    assert [texts(p) for p in json.loads(got[3])] == [["a", "b", "c", "d"], ["e"]]
    assert [texts(p) for p in json.loads(got[9])] == [["a", "c", "b"]]
    assert set(got) == {3, 4, 9}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
