"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over whole driver
tables (or data Spark derives from them). Output columns are named and
typed to match the DuckDB oracle in ``oracle.py``: integers as BIGINT,
fractional values rounded to 6 decimals (both engines sum in different
orders).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions import normalize as norm
from ..operators import assemble, attempts, boxes, cache, engine, evaluate, flatten, metrics, pages, raster
from ..operators import spelling, votes
from ..params import Params, alias_columns
from ..session import new_table_path, spread
from ..sources import files
from ..sources.readers import read_eval_lines, read_lexicon, word_freq, write_results
from ..streaming.ingest import read_store, stream_ingest
from ..streaming.metrics import read_metrics, read_windows, stream_metrics, stream_windows, windowed_metrics
from . import fixtures as fx

PARAMS = Params()
TS_LATEST = "2030-01-01 00:00:00"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ------------------------------------------------------------------ engine payloads -> lines
def _walked(spark, sf) -> flatten.Walked:
    return flatten.Walked(spread(fx.fx_engine_json(spark, sf)), min_confidence=PARAMS.min_confidence)


def q_read_engine_json(spark, sf):
    p = flatten.parse_payloads(spread(fx.fx_engine_json(spark, sf)))
    return p.select(big("key").alias("doc_id"), flatten.top_kind().alias("top_kind"))


def q_payload_rejects(spark, sf):
    return _walked(spark, sf).rejects.select(big("doc_id").alias("doc_id"), "reason")


def q_normalise_pages(spark, sf):
    """Pages and their entries as found, whatever the confidence of the lines."""
    lines = _walked(spark, sf).page_lines
    return lines.groupBy("doc_id").agg(big(F.count_distinct("page")).alias("n_pages"),
                                       big(F.count(F.lit(1))).alias("n_entries"))


def q_parse_entry(spark, sf):
    lines = _walked(spark, sf).page_lines
    blk = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return lines.select(big("doc_id").alias("doc_id"), big(blk).alias("block"), big("pos").alias("pos"),
                        "text", r6("score").alias("score"))


def q_flatten_bbox(spark, sf):
    l = _walked(spark, sf).lines()
    bb = F.array_join(F.transform("bbox", lambda x: x.cast("bigint").cast("string")), ",")
    return l.select(big("doc_id").alias("doc_id"), big("block_id").alias("block_id"),
                    big("line_id").alias("line_id"), bb.alias("bbox"))


def q_min_confidence(spark, sf):
    l = _walked(spark, sf).lines()
    return l.select(big("doc_id").alias("doc_id"), "text", r6("confidence").alias("confidence"))


def q_number_lines(spark, sf):
    l = _walked(spark, sf).lines()
    return l.select(big("doc_id").alias("doc_id"), big("block_id").alias("block_id"),
                    big("line_id").alias("line_id"), "text")


def q_collect_fallback(spark, sf):
    l = _walked(spark, sf).lines().where(F.col("mode") == "fallback")
    return l.select(big("doc_id").alias("doc_id"), big("block_id").alias("block_id"),
                    big("line_id").alias("line_id"), "text")


def q_assemble_text(spark, sf):
    a = _walked(spark, sf).documents()
    return a.select(big("doc_id").alias("doc_id"), "text", big(F.size("blocks")).alias("n_blocks"), "reject")


def q_text_stats(spark, sf):
    a = _walked(spark, sf).documents()
    st = assemble.text_stats(F.col("text"), F.col("blocks"))
    return a.select(big("doc_id").alias("doc_id"), big(st["text_chars"]).alias("text_chars"),
                    big(st["blocks_n"]).alias("blocks"), st["empty_text"].alias("empty_text"))


def _responses(spark, sf):
    """Every payload's response: lines -> text -> spelling -> language -> normalisation -> meta."""
    a = flatten.stored(_walked(spark, sf).documents(), "assembled")
    if PARAMS.use_spell_correction:
        a = spelling.spell_correct(a, _lexicon(spark, sf))
    a = a.withColumn("language", lang.language_heuristic(F.col("text")))
    a = norm.normalize_frame(a)
    meta = assemble.attach_meta(PARAMS, source=F.lit(None), path=F.concat(F.lit("/in/"), F.col("doc_id").cast("string")),
                                width=F.lit(None), height=F.lit(None), duration_ms=F.lit(None),
                                device=F.lit("cpu"), engine_name=F.lit("replay"),
                                engine_language=F.lit(PARAMS.primary_language))
    return a.withColumn("meta", meta)


def q_response_struct(spark, sf):
    """Flagship: one response per payload, also where it holds no text."""
    resp = _responses(spark, sf)
    return resp.select(big("doc_id").alias("doc_id"), "text", "language",
                       big(F.size("blocks")).alias("blocks_n"),
                       F.array_join("emails", ",").alias("emails"), F.array_join("urls", ",").alias("urls"),
                       F.col("meta.path").alias("meta_path"), "reject")


# ------------------------------------------------------------------ normalisation
def _receipts(spark, sf):
    return spread(fx.fx_receipts(spark, sf))


def q_norm_dates(spark, sf):
    return _receipts(spark, sf).select(big("doc_id").alias("doc_id"), norm.norm_dates(F.col("text")).alias("text"))


def q_norm_numbers(spark, sf):
    return _receipts(spark, sf).select(big("doc_id").alias("doc_id"), norm.norm_numbers(F.col("text")).alias("text"))


def q_norm_currency(spark, sf):
    return _receipts(spark, sf).select(big("doc_id").alias("doc_id"), norm.norm_currency(F.col("text")).alias("text"))


def q_extract_emails(spark, sf):
    r = _receipts(spark, sf)
    found = norm.find_emails(F.col("text"))
    return r.select(big("doc_id").alias("doc_id"), F.array_join(F.transform(found, F.lower), ",").alias("emails"),
                    norm.lower_each(F.col("text"), found).alias("text"))


def q_extract_urls(spark, sf):
    r = _receipts(spark, sf)
    found = norm.find_urls(F.col("text"))
    return r.select(big("doc_id").alias("doc_id"), F.array_join(F.transform(found, F.lower), ",").alias("urls"),
                    norm.lower_each(F.col("text"), found).alias("text"))


def q_normalize_text(spark, sf):
    r = norm.normalize_frame(_receipts(spark, sf))
    return r.select(big("doc_id").alias("doc_id"), "text", F.array_join("emails", ",").alias("emails"),
                    F.array_join("urls", ",").alias("urls"))


# ------------------------------------------------------------------ language
def q_language_heuristic(spark, sf):
    t = spread(fx.fx_lang(spark, sf))
    return t.select(big("k").alias("k"), lang.language_heuristic(F.col("text")).alias("language"))


def q_resolve_engine_language(spark, sf):
    t = fx.fx_langs(spark, sf)
    return t.select(big("doc_id").alias("doc_id"), lang.resolve_engine_language(F.col("languages")).alias("engine_language"))


def q_primary_language(spark, sf):
    t = fx.fx_langs(spark, sf)
    return t.select(big("doc_id").alias("doc_id"), lang.primary_language(F.col("languages")).alias("primary_language"),
                    lang.languages_str(F.col("languages")).alias("languages_str"))


def q_language_votes(spark, sf):
    docs = fx.fx_vote_texts(spark, sf)
    v = votes.language_votes(fx.fx_votes(spark, sf), docs)
    return v.select(big("doc_id").alias("doc_id"), "language", "from_detector")


# ------------------------------------------------------------------ cache
def _inputs(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    return d.withColumn("key", cache.content_key(F.col("text")))


def _compute(df: DataFrame) -> DataFrame:
    """Stand-in recognition for cache misses: the language heuristic on the text."""
    return df.select("key", "text", lang.language_heuristic(F.col("text")).alias("language"),
                     F.lit("paddle").alias("engine_name"), F.lit(None).cast("string").alias("error"))


def _compute_or_fail(df: DataFrame) -> DataFrame:
    """The same, failing on every 50th text length."""
    return _compute(df).withColumn("error", F.when(F.length("text") % 50 == 0, F.lit("unreadable")))


def _cache_table(spark, sf):
    return fx.fx_cache(spark, sf).drop("origin_doc")


def q_content_key(spark, sf):
    return _inputs(spark, sf).select(big("doc_id").alias("doc_id"), "key")


def q_cache_hits(spark, sf):
    h = cache.cache_hits(_inputs(spark, sf), _cache_table(spark, sf))
    return h.select(big("doc_id").alias("doc_id"), "key", F.col("cached_language").alias("language"),
                    big(F.length("cached_text")).alias("cached_chars"))


def q_cache_misses(spark, sf):
    m = cache.cache_misses(_inputs(spark, sf), _cache_table(spark, sf))
    return m.select(big("doc_id").alias("doc_id"), "key")


def q_cache_evict_dummy(spark, sf):
    c = cache.evict_dummy(fx.fx_cache(spark, sf))
    return c.select("key", big("origin_doc").alias("origin_doc"), "engine_name")


def _get_or_set(spark, sf, compute=_compute):
    return cache.get_or_set(_inputs(spark, sf), _cache_table(spark, sf), compute, now=F.lit(TS_LATEST).cast("timestamp"))


def q_cache_get_or_set(spark, sf):
    results, _ = _get_or_set(spark, sf)
    return results.select(big("doc_id").alias("doc_id"), "key", F.col("result_language").alias("language"),
                          big(F.length("result_text")).alias("text_chars"), "from_cache")


def q_cache_upsert(spark, sf):
    """Two rounds of results over the stored table; the newest row of a key stays."""
    _, new_cache = _get_or_set(spark, sf)
    out = cache.cache_upsert(_cache_table(spark, sf), new_cache)
    return out.select("key", "language", "engine_name", F.col("created_at").cast("string").alias("created_at"))


def q_upsert_union(spark, sf):
    old = cache.valid_cache(fx.fx_cache(spark, sf)).select("key", "engine_name", F.col("origin_doc").alias("doc_id"))
    new = (cache.dedupe_content(cache.cache_misses(_inputs(spark, sf), _cache_table(spark, sf)))
           .select("key", F.lit("paddle").alias("engine_name"), "doc_id"))
    out = cache.replace_by_key(old, new)
    return out.select("key", "engine_name", big("doc_id").alias("doc_id"))


def q_dedupe_content(spark, sf):
    i = cache.dedupe_content(_inputs(spark, sf))
    return i.select("key", big("doc_id").alias("first_doc"), big(F.length("text")).alias("text_chars"))


def q_warm_cache(spark, sf):
    """Everything processed, failures kept as rows."""
    results, _ = _get_or_set(spark, sf, _compute_or_fail)
    return cache.warm_cache(results)


def q_process_batch(spark, sf):
    """All-or-nothing; a failed row aborts the job. Ordered by key."""
    results, _ = _get_or_set(spark, sf)
    done = cache.process_batch(results)
    return done.select(big("doc_id").alias("doc_id"), "key", F.col("result_language").alias("language"))


# ------------------------------------------------------------------ pages
def q_page_table(spark, sf):
    p = pages.page_table(fx.fx_pages(spark, sf), max_pages=PARAMS.max_pdf_pages)
    return p.select(big("pdf").alias("pdf"), big("page_index").alias("page_index"), "embedded_text")


def q_merge_page_text(spark, sf):
    """Pages through cache and engine, merged with embedded text, as responses."""
    p = fx.fx_pages(spark, sf)
    stored = cache.evict_dummy(_cache_table(spark, sf))
    r = pages.page_responses(p.withColumn("content", F.col("ocr_text")), stored, _compute, PARAMS, now=F.lit(TS_LATEST).cast("timestamp"))
    return r.select(F.col("meta.source_pdf").alias("source_pdf"), big("meta.page_index").alias("page_index"), "text", "language")


def q_merge_text_safe(spark, sf):
    p = fx.fx_pages(spark, sf)
    return p.select(big("pdf").alias("pdf"), big("page_index").alias("page_index"),
                    pages.merge_text_safe(F.col("ocr_text"), F.col("embedded_text")).alias("text"))


# ------------------------------------------------------------------ evaluation
def _pairs(spark, sf):
    c = spread(fx.fx_cer(spark, sf))
    preds = c.select(F.col("doc_id").alias("row_id"), F.col("hyp").alias("text"))
    truths = c.select(F.col("doc_id").alias("row_id"), F.col("ref").alias("text"))
    return evaluate.pair_eval(preds, truths)


def q_pair_eval(spark, sf):
    p = _pairs(spark, sf)
    return p.select(big("row_id").alias("row_id"), F.md5("ref").alias("ref_md5"), F.md5("hyp").alias("hyp_md5"))


def q_cer(spark, sf):
    c = spread(fx.fx_cer(spark, sf))
    return evaluate.score_pairs(c, rates=("cer",)).select(big("doc_id").alias("doc_id"), r6("cer").alias("cer"))


def q_wer(spark, sf):
    w = spread(fx.fx_wer(spark, sf))
    return evaluate.score_pairs(w, rates=("wer",)).select(big("doc_id").alias("doc_id"), r6("wer").alias("wer"))


def q_wer_documents(spark, sf):
    w = spread(fx.fx_wer_documents(spark, sf))
    return evaluate.score_pairs(w, rates=("wer",)).select(big("doc_id").alias("doc_id"), r6("wer").alias("wer"))


def q_mean_cer_wer(spark, sf):
    s = evaluate.score_pairs(fx.fx_wer(spark, sf))
    m = evaluate.mean_cer_wer(s)
    return m.select(r6("mean_cer").alias("mean_cer"), r6("mean_wer").alias("mean_wer"), big("n").alias("n"))


def q_latency_report(spark, sf):
    r = metrics.latency_report(fx.fx_requests(spark, sf))
    return r.select("endpoint", big("count").alias("count"), r6("p50").alias("p50"), r6("p95").alias("p95"),
                    r6("throughput").alias("throughput"))


def _metrics_out(df):
    return df.select("endpoint", big("count").alias("count"), r6("sum").alias("sum"), "le",
                     big("bucket_count").alias("bucket_count"))


def q_request_metrics(spark, sf):
    return _metrics_out(metrics.request_metrics(fx.fx_requests(spark, sf)))


def q_first_success(spark, sf):
    w = attempts.first_success(fx.fx_attempts(spark, sf))
    return w.select(big("doc_id").alias("doc_id"), big("winner").alias("winner"),
                    big(F.length("text")).alias("text_chars"), r6("duration_ms").alias("duration_ms"))


# ------------------------------------------------------------------ boxes, sizes, params, meta
def q_box_filter(spark, sf):
    b = boxes.box_filter(fx.fx_boxes(spark, sf))
    return b.select(*[big(c).alias(c) for c in ("image_id", "box_no", "x1", "y1", "x2", "y2")])


def q_table_summary(spark, sf):
    t = boxes.table_summary(fx.fx_boxes(spark, sf))
    cells = F.transform("tables", lambda t: F.concat(F.array_join(F.transform(t["bbox"], lambda x: x.cast("string")), ","),
                                                     F.lit("/"), t["cells"].cast("string")))
    return t.select(big("image_id").alias("image_id"), F.array_join(cells, ";").alias("tables"))


def q_image_size(spark, sf):
    d = fx.fx_dims(spark, sf)
    s = assemble.image_size(F.col("w"), F.col("h"))
    return d.select(big("image_id").alias("image_id"), big(s[0]).alias("width"), big(s[1]).alias("height"))


def q_alias_columns(spark, sf):
    a = alias_columns(fx.fx_params(spark, sf))
    return a.select(big("id").alias("id"), r6("text_det_limit_side_len").alias("text_det_limit_side_len"),
                    r6("text_det_thresh").alias("text_det_thresh"), "text_recognition_model_name")


def q_source_label(spark, sf):
    s = fx.fx_sources(spark, sf)
    return s.select(big("id").alias("id"), assemble.source_label(F.col("source"), F.col("path")).alias("label"))


def q_attach_meta(spark, sf):
    s = fx.fx_sources(spark, sf)
    p = Params(handwriting_mode=True)
    size = F.when(F.col("id") % 4 != 0, F.col("id") % 1000)
    meta = assemble.attach_meta(p, source=F.col("source"), path=F.col("path"), width=size, height=size + 1,
                                duration_ms=F.lit(0.0), device=F.lit("cpu"), engine_name=F.lit("dummy"),
                                engine_language=F.lit("en"))
    m = s.select("id", meta.alias("meta"))
    return m.select(big("id").alias("id"),
                    assemble.source_label(F.col("meta.source"), F.col("meta.path")).alias("label"),
                    F.array_join("meta.warnings", "|").alias("warnings"),
                    F.col("meta.engine.ocr_version").alias("ocr_version"),
                    F.array_join(F.transform("meta.image_size", lambda x: x.cast("string")), "x").alias("image_size"))


def q_dummy_engine(spark, sf):
    d = fx.fx_dims(spark, sf)
    size = assemble.image_size(F.col("w"), F.col("h"))
    out = engine.dummy_output(size[0], size[1], F.array(*[F.lit(x) for x in PARAMS.languages]))
    r = d.select("image_id", out.alias("o"))
    bb = F.array_join(F.transform("o.blocks", lambda b: F.array_join(
        F.transform(b["bbox"], lambda x: x.cast("bigint").cast("string")), ",")), ";")
    return r.select(big("image_id").alias("image_id"), F.col("o.text").alias("text"), bb.alias("bbox"),
                    F.col("o.language").alias("language"), F.col("o.device").alias("device"))


def q_run_engine(spark, sf):
    j = spread(fx.fx_engine_json(spark, sf)).select(F.col("doc_id").cast("string").alias("key"),
                                                   F.encode("j", "UTF-8").alias("content"))
    out = engine.run_engine(j, engine.JsonPayloadEngine, PARAMS.languages, name="replay")
    return out.select("key", big(F.length("text")).alias("text_chars"), "engine_name", "error")


# ------------------------------------------------------------------ rasters
def q_grayscale(spark, sf):
    g = raster.grayscale(fx.fx_rgb(spark, sf))
    return g.select(*[big(c).alias(c) for c in ("image_id", "y", "x", "v")])


def q_invert(spark, sf):
    g = raster.invert(fx.fx_raster(spark, sf))
    return g.select(*[big(c).alias(c) for c in ("image_id", "y", "x", "v")])


def q_contrast_stretch(spark, sf):
    g = raster.contrast_stretch(fx.fx_raster(spark, sf))
    return g.select(*[big(c).alias(c) for c in ("image_id", "y", "x", "v")])


def q_mean_threshold(spark, sf):
    g = raster.mean_threshold(fx.fx_raster(spark, sf))
    return g.select(*[big(c).alias(c) for c in ("image_id", "y", "x", "v")])


def q_best_rotation(spark, sf):
    r = raster.best_rotation(fx.fx_raster(spark, sf))
    return r.select(big("image_id").alias("image_id"), big("angle").alias("angle"))


def q_skew_angle(spark, sf):
    s = raster.skew_angle(fx.fx_theta(spark, sf))
    return s.select(big("image_id").alias("image_id"), r6("angle").alias("angle"), "rotate")


def q_raster_stats(spark, sf):
    s = raster.raster_stats(fx.fx_raster(spark, sf))
    return s.select(big("image_id").alias("image_id"), big("height").alias("height"), big("width").alias("width"),
                    r6("mean_v").alias("mean_v"))


def q_projection_score(spark, sf):
    s = raster.projection_score(fx.fx_raster(spark, sf))
    return s.select(big("image_id").alias("image_id"), big("rows").alias("rows"), big("score_n2").alias("score_n2"),
                    r6("score").alias("score"))


def _channel_images(spark, sf):
    """Pixel tables with 1-4 channels from the embeddings (channel count by key)."""
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nc = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4), F.lit(2)), (F.col("vec_id") % 4 + 1).cast("int"))
    x = e.select(F.col("vec_id").alias("image_id"), nc.alias("channels"), F.posexplode("embedding").alias("p", "e"))
    px = x.select("image_id", (F.col("p") / F.col("channels")).cast("int").alias("y"), F.lit(0).alias("x"),
                  (F.col("p") % F.col("channels")).cast("int").alias("c"),
                  F.floor((F.col("e").cast("double") + 1) * 127).cast("int").alias("v"))
    return px, x.select("image_id", "channels").distinct()


def q_bgr_channels(spark, sf):
    px, ch = _channel_images(spark, sf)
    ok, rejects = raster.bgr_channels(px, ch)
    good = ok.groupBy("image_id").agg(big(F.count(F.lit(1))).alias("n_values"), big(F.sum("v")).alias("sum_v"))
    good = good.select(big("image_id").alias("image_id"), F.lit("ok").alias("status"), "n_values", "sum_v")
    bad = rejects.select(big("image_id").alias("image_id"), F.col("reason").alias("status"),
                         F.lit(0).cast("bigint").alias("n_values"), F.lit(0).cast("bigint").alias("sum_v"))
    return good.unionByName(bad)


# ------------------------------------------------------------------ files
def _paths(spark, sf):
    return fx.fx_paths(spark, sf)


def q_scan_images(spark, sf):
    return files.scan_images(_paths(spark, sf), PARAMS).select("path", big("length").alias("length"))


def q_scan_batch(spark, sf):
    return files.scan_batch(_paths(spark, sf), limit=100, params=PARAMS).select("path", big("length").alias("length"))


def q_scan_batch_all(spark, sf):
    return files.scan_batch(_paths(spark, sf), params=PARAMS).select("path", big("length").alias("length"))


def q_route_paths(spark, sf):
    return _paths(spark, sf).select("path", files.route(F.col("path"), F.lit(False)).alias("route"))


def q_scan_any(spark, sf):
    return files.scan_any(_paths(spark, sf), limit=100).select("path", big("length").alias("length"))


def q_size_guard(spark, sf):
    g = files.size_guard(_paths(spark, sf), PARAMS)
    return g.select("path", big("length").alias("length"), "accepted", "reason")


# ------------------------------------------------------------------ spelling
def _lexicon(spark, sf):
    return word_freq(fx.fx_lexicon_words(spark, sf))


def q_word_freq(spark, sf):
    w = _lexicon(spark, sf)
    return w.select("lang", "word", big("freq").alias("freq"))


def q_read_lexicon(spark, sf):
    """Lexicon files written from the words, read back by language."""
    folder = new_table_path(spark, "lexicon")
    words = fx.fx_lexicon_words(spark, sf)
    for language in PARAMS.languages:
        words.where(F.col("lang") == language).select("word").write.text(f"{folder}/{language}.txt")
    w = read_lexicon(spark, folder, PARAMS.languages)
    return w.select("lang", "word", big("freq").alias("freq"))


def q_spell_candidates(spark, sf):
    c = spelling.spell_candidates(fx.fx_words(spark, sf), _lexicon(spark, sf))
    return c.select("tok", "word", big("freq").alias("freq"), big("dist").alias("dist"))


def q_spell_correct(spark, sf):
    conv = spread(fx.table(spark, sf, "conversations")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    out = spelling.spell_correct(conv, _lexicon(spark, sf))
    return out.select(big("doc_id").alias("doc_id"), "text")


# ------------------------------------------------------------------ sink / streaming
def q_write_results(spark, sf):
    """K1, K2: the public records written as JSON and read back."""
    path = new_table_path(spark, "responses")
    record = assemble.response_struct(_responses(spark, sf))
    write_results(record, path)
    back = spark.read.schema(record.schema).json(path)
    return back.select(F.col("meta.path").alias("path"), "text", "language", big(F.size("blocks")).alias("blocks_n"),
                       F.md5(F.array_join(F.transform("blocks", lambda x: x["text"]), "|")).alias("blocks_md5"),
                       F.col("meta.engine.name").alias("engine"))


def q_read_eval_sets(spark, sf):
    """Predictions and truths as folders of JSON lines, written and read back."""
    c = fx.fx_wer(spark, sf)
    preds, truths = new_table_path(spark, "predictions"), new_table_path(spark, "truths")
    for text, path in (("hyp", preds), ("ref", truths)):      # part files are in the order of the sort
        c.orderBy("doc_id", "ref", "hyp").select(F.to_json(F.struct(F.col(text).alias("text"))).alias("value")).write.text(path)
    p, t = read_eval_lines(spark, preds, truths)
    pairs = evaluate.pair_eval(p, t)
    return pairs.select(big("row_id").alias("row_id"), "ref", "hyp")


def q_stream_ingest(spark, sf):
    src = f"{sf.rstrip('/')}/documents*.parquet"
    store = new_table_path(spark, "stream-store")
    stream_ingest(spark, src, "doc_id long, text string, lang string, source string, n_chars long", store,
                  new_table_path(spark, "stream-ingest-ckpt"))
    return read_store(spark, store).select("key", "language", "text")


def _event_stream(spark, sf):
    return (f"{sf.rstrip('/')}/events*.parquet",
            "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def q_stream_metrics(spark, sf):
    out = new_table_path(spark, "stream-metrics")
    stream_metrics(spark, *_event_stream(spark, sf), out, new_table_path(spark, "stream-metrics-ckpt"))
    return _metrics_out(read_metrics(spark, out))


def _windows_out(w):
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "endpoint", big("count").alias("count"), r6("sum").alias("sum"))


def q_windowed_metrics(spark, sf):
    """The windowed form over the events table (a watermark does nothing in batch)."""
    return _windows_out(windowed_metrics(fx.fx_requests(spark, sf)))


def q_stream_windows(spark, sf):
    """The windowed form as a stream: the windows that the watermark has closed."""
    out = new_table_path(spark, "stream-windows")
    stream_windows(spark, *_event_stream(spark, sf), out, new_table_path(spark, "stream-windows-ckpt"))
    return _windows_out(read_windows(spark, out))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources
    "scan_images": q_scan_images, "scan_batch": q_scan_batch, "scan_any": q_scan_any, "size_guard": q_size_guard,
    "page_table": q_page_table, "read_engine_json": q_read_engine_json, "source_label": q_source_label, "route_paths": q_route_paths,
    "read_lexicon": q_read_lexicon, "read_eval_sets": q_read_eval_sets, "payload_rejects": q_payload_rejects,
    "scan_batch_all": q_scan_batch_all,
    # sinks
    "write_results": q_write_results, "response_struct": q_response_struct,
    # row level
    "min_confidence": q_min_confidence, "box_filter": q_box_filter, "image_size": q_image_size,
    "alias_columns": q_alias_columns, "attach_meta": q_attach_meta, "text_stats": q_text_stats,
    "bgr_channels": q_bgr_channels,
    # flattening
    "normalise_pages": q_normalise_pages, "parse_entry": q_parse_entry, "flatten_bbox": q_flatten_bbox,
    "number_lines": q_number_lines, "collect_fallback": q_collect_fallback, "assemble_text": q_assemble_text,
    # joins
    "cache_hits": q_cache_hits, "cache_misses": q_cache_misses, "merge_page_text": q_merge_page_text,
    "merge_text_safe": q_merge_text_safe, "pair_eval": q_pair_eval, "spell_candidates": q_spell_candidates,
    # aggregations
    "mean_cer_wer": q_mean_cer_wer, "latency_report": q_latency_report, "request_metrics": q_request_metrics,
    "language_votes": q_language_votes, "table_summary": q_table_summary, "word_freq": q_word_freq,
    "skew_angle": q_skew_angle, "raster_stats": q_raster_stats, "projection_score": q_projection_score,
    # windows / ordered selection
    "first_success": q_first_success, "contrast_stretch": q_contrast_stretch, "mean_threshold": q_mean_threshold,
    "best_rotation": q_best_rotation, "upsert_union": q_upsert_union, "dedupe_content": q_dedupe_content,
    # scalar functions
    "norm_dates": q_norm_dates, "norm_numbers": q_norm_numbers, "norm_currency": q_norm_currency,
    "extract_emails": q_extract_emails, "extract_urls": q_extract_urls, "normalize_text": q_normalize_text,
    "spell_correct": q_spell_correct, "language_heuristic": q_language_heuristic,
    "resolve_engine_language": q_resolve_engine_language, "primary_language": q_primary_language,
    "cer": q_cer, "wer": q_wer, "wer_documents": q_wer_documents, "content_key": q_content_key, "grayscale": q_grayscale, "invert": q_invert,
    # cache
    "cache_get_or_set": q_cache_get_or_set, "cache_upsert": q_cache_upsert, "cache_evict_dummy": q_cache_evict_dummy,
    "warm_cache": q_warm_cache, "process_batch": q_process_batch,
    # streaming
    "stream_ingest": q_stream_ingest, "stream_metrics": q_stream_metrics, "windowed_metrics": q_windowed_metrics,
    "stream_windows": q_stream_windows,
    # engines
    "run_engine": q_run_engine, "dummy_engine": q_dummy_engine,
}
