"""Derived inputs built by Spark from the driver tables.

Every fixture reads whole tables, whole texts and whole vectors. Each has a
DuckDB twin in ``pagetext.plans.oracle`` producing the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# Sentence templates of the language fixture.
ID_SENTENCE = "Halo apa kabar kamu sedang di mana"
EN_SENTENCE = "Please pay this invoice within seven days"
LINES_PER_PAGE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_text(c: Column) -> Column:
    return F.regexp_replace(c, "[^ -~]", "?")


def py_split(c: Column) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def line_score(doc_id: Column, line: Column) -> Column:
    return ((doc_id * 7919 + line * 104729) % 1000).cast("double") / 1000.0


# ------------------------------------------------------------------ text lines
def fx_lines(spark, sf_dir) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return (d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
            .withColumn("score", line_score(F.col("doc_id"), F.col("line"))))


def _json_str(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


# The spellings of an entry, cycled over the documents.
BOX_SPELLINGS = ("bbox", "box", "points", "polygon", "poly", "position", "box.points")
TEXT_SPELLINGS = ("text", "value", "content", "label", "transcription")
SCORE_SPELLINGS = ("score", "confidence", "prob", "probability", "score.confidence", "score[]")
BROKEN_EVERY, WRAPPED_EVERY = 97, 13


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _entry_json(shape: Column, k: Column, text: Column, score: Column, i: Column) -> Column:
    t, s = _json_str(text), score.cast("string")
    b = F.concat(F.lit("[[0,"), i.cast("string"), F.lit("],[10,"), i.cast("string"), F.lit("]]"))
    box, word, num = _pick(BOX_SPELLINGS, k), _pick(TEXT_SPELLINGS, k), _pick(SCORE_SPELLINGS, k)
    box = F.when(box == "box.points", F.concat(F.lit('"box":{"points":'), b, F.lit("}"))).otherwise(F.concat(F.lit('"'), box, F.lit('":'), b))
    num = (F.when(num == "score.confidence", F.concat(F.lit('"score":{"confidence":'), s, F.lit("}")))
           .when(num == "score[]", F.concat(F.lit('"score":['), s, F.lit("]"))).otherwise(F.concat(F.lit('"'), num, F.lit('":'), s)))
    entry = F.concat(F.lit("{"), box, F.lit(',"'), word, F.lit('":'), t, F.lit(","), num, F.lit("}"))
    return (F.when(shape == 1, F.concat(F.lit("["), b, F.lit(",["), t, F.lit(","), s, F.lit("]]")))
            .when(shape == 2, F.concat(F.lit("["), b, F.lit(",["), t, F.lit(","), s, F.lit('],{"extra":true}]')))
            .when(shape == 4, F.concat(F.lit('{"line":'), entry, F.lit("}"))).otherwise(entry))


def fx_engine_json(spark, sf_dir) -> DataFrame:
    """One recognition payload per document, six payload shapes by ``doc_id % 6``:

    0 ``{"data":[entry...]}``; 1 pages of ``[box,[text,score]]``; 2 the same with a
    third ``{"extra":true}`` part; 3 pages of entries; 4 ``[{"res":[{"line":entry}]}...]``;
    5 entries under non-container keys (only the fallback walk finds them). Entries
    are objects whose keys take all spellings in turn. Every 13th payload has two
    more lists around it, every 97th lacks its last character and is no JSON.
    Pages hold four lines.
    """
    shape, k = (F.col("doc_id") % 6).cast("int"), F.floor(F.col("doc_id") / 6).cast("long")
    lines = fx_lines(spark, sf_dir)
    entry = _entry_json(shape, k, F.col("text"), F.col("score"), F.col("line"))

    # one shuffle of entries; the pages are cut from the sorted lines of the document
    rows = lines.select("doc_id", F.col("line").cast("int").alias("line"), entry.alias("e"))
    d = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "e"))).alias("l"))
    last = F.element_at("l", -1)["line"]
    listed = lambda l: F.array_join(F.transform(l, lambda x: x["e"]), ",")
    numbers = F.sequence(F.lit(0), F.floor(last / LINES_PER_PAGE).cast("int"))
    # texts that share a doc_id are merged line by line, so their pages hold more than four entries
    paged = F.when(F.size("l") == last + 1, F.transform(numbers, lambda p: listed(F.slice("l", p * LINES_PER_PAGE + 1, LINES_PER_PAGE)))).otherwise(
        F.filter(F.transform(numbers, lambda p: listed(F.filter("l", lambda x: F.floor(x["line"] / LINES_PER_PAGE) == p))), lambda e: e != ""))
    page = lambda e: F.when(shape == 4, F.concat(F.lit('{"res":['), e, F.lit("]}"))).otherwise(F.concat(F.lit("["), e, F.lit("]")))
    d = d.select("doc_id", F.when(shape.isin(0, 5), listed(F.col("l"))).otherwise(F.array_join(F.transform(paged, page), ",")).alias("e"))      # 0 and 5 have no pages
    payload = (F.when(shape == 0, F.concat(F.lit('{"data":['), F.col("e"), F.lit("]}")))
               .when(shape == 5, F.concat(F.lit('{"output":{"lines":['), F.col("e"), F.lit("]}}")))
               .otherwise(F.concat(F.lit("["), F.col("e"), F.lit("]"))))
    payload = F.when(F.col("doc_id") % WRAPPED_EVERY == 5, F.concat(F.lit("[["), payload, F.lit("]]"))).otherwise(payload)
    payload = F.when(F.col("doc_id") % BROKEN_EVERY == BROKEN_EVERY - 1, F.substring(payload, F.lit(1), F.length(payload) - 1)).otherwise(payload)
    return d.select("doc_id", payload.alias("j"))


# ------------------------------------------------------------------ normalisation / language
def fx_receipts(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    amount = F.regexp_replace(F.floor("o_totalprice").cast("bigint").cast("string"), r"(\d)(\d\d\d)$", "$1.$2")
    text = F.concat(F.lit("tanggal "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" harga rp "), amount,
                    F.lit(",56 bayar ke A"), F.col("o_custkey").cast("string"),
                    F.lit("@Mail.COM lihat https://X.com/"), F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def fx_lang(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.concat(F.lit(ID_SENTENCE + " "), F.col("o_orderpriority")))
            .when(k == 1, F.concat(F.lit(EN_SENTENCE + " "), F.col("o_orderpriority")))
            .when(k == 2, F.lit("   "))
            .when(k == 3, F.lit("12345"))
            .otherwise(F.concat(F.lit("ku the "), F.col("o_orderpriority"))))
    return o.select(F.col("o_orderkey").alias("k"), text.alias("text"))


def fx_langs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id") % 5
    arr = (F.when(k == 0, F.array(F.lit("auto")))
           .when(k == 1, F.array(F.lit("id"), F.lit("en")))
           .when(k == 2, F.array(F.lit("ru")))
           .when(k == 3, F.array(F.lit("ru"), F.lit("en")))
           .otherwise(F.array().cast("array<string>")))
    return d.select("doc_id", arr.alias("languages"))


def fx_votes(spark, sf_dir) -> DataFrame:
    """Three detector candidates per document, in detector (rank) order."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    codes = F.array(*[F.lit(c) for c in ("en", "id", "ms", "jv", "fr")])
    r = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank")
    x = d.select("doc_id", r)
    return x.select("doc_id", F.col("rank").cast("int").alias("rank"),
                    F.element_at(codes, ((F.col("doc_id") * 3 + F.col("rank")) % 5 + 1).cast("int")).alias("code"),
                    (((F.col("doc_id") * 37 + F.col("rank") * 11) % 100).cast("double") / 100.0).alias("prob"))


def fx_vote_texts(spark, sf_dir) -> DataFrame:
    """The documents, every 11th with blank text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.lit("  \n ")).otherwise(F.col("text")))


# ------------------------------------------------------------------ evaluation
def fx_cer(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    ref = ascii_text(F.col("text"))
    return d.select("doc_id", ref.alias("ref"), F.translate(ref, "oil", "011").alias("hyp"))


def _misread(df: DataFrame, key: Column, text: Column) -> DataFrame:
    ref = ascii_text(text)
    kept = F.filter(py_split(ref), lambda t, i: i % 7 != 6)
    hyp = F.transform(kept, lambda t: F.when(F.length(t) > 6, F.translate(t, "oil", "011")).otherwise(t))
    return df.select(key.alias("doc_id"), ref.alias("ref"), F.array_join(hyp, " ").alias("hyp"))


def fx_wer(spark, sf_dir) -> DataFrame:
    """Conversation turns and the same with every 7th token left out and long tokens misread."""
    return _misread(table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"), F.coalesce("text", F.lit("")))


def fx_wer_documents(spark, sf_dir) -> DataFrame:
    """The same of whole documents."""
    return _misread(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


# ------------------------------------------------------------------ attempts / requests
def fx_attempts(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    ok = (x["doc_id"] * 31 + x["ord"] * 17) % 5 == 0
    return x.select("doc_id", F.col("ord").cast("int").alias("ord"),
                    F.when(ok, F.col("text")).otherwise(F.lit("")).alias("text"),
                    ((F.col("doc_id") + F.col("ord")) % 50).cast("double").alias("ms"))


def fx_requests(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("endpoint"), (F.col("value") / 100.0).alias("seconds"), "ts")


# ------------------------------------------------------------------ files / sources / pages
SUFFIXES = (".png", ".JPG", ".tif", ".pdf", ".txt", "")


def fx_paths(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), suffix)
    # one kibibyte per character: the longest documents exceed the 20 MB cap
    return d.select(path.alias("path"), (F.col("n_chars") * 1024).alias("length"))


def fx_sources(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    k = F.col("doc_id") % 3
    return d.select(F.col("doc_id").alias("id"),
                    F.when(k == 0, F.concat(F.lit("https://files.example/"), F.col("source"))).alias("source"),
                    F.when(k == 1, F.concat(F.lit("/in/"), F.col("source"), F.lit("/"),
                                            F.col("doc_id").cast("string"))).alias("path"))


def fx_pages(spark, sf_dir) -> DataFrame:
    """A document per conversation, a page per turn: embedded text on user turns."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("pdf"), F.col("turn").cast("int").alias("page_index"),
                    F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("")).alias("embedded_text"),
                    F.when((F.col("role") == "system") | (F.col("turn") == 2), F.lit(""))
                    .otherwise(F.col("text")).alias("ocr_text"))


def fx_cache(spark, sf_dir) -> DataFrame:
    """Stored results: labelled documents, keyed by content hash.

    Low-quality labels were produced by the dummy engine; exact copies of a
    text give the same key twice with different ``created_at``.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    x = d.join(lab, "doc_id")
    return x.select(
        F.sha2(F.col("text"), 256).alias("key"),
        F.col("text"),
        F.col("lang").alias("language"),
        F.when(F.col("quality") == 0, F.lit("dummy")).otherwise(F.lit("paddle")).alias("engine_name"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("created_at"),
        F.col("doc_id").alias("origin_doc"))


# ------------------------------------------------------------------ boxes / rasters
def fx_boxes(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("box_no"),
                     (F.col("l_linenumber") * 10).cast("int").alias("x"),
                     (F.col("l_partkey") % 100).cast("int").alias("y"),
                     F.col("l_quantity").cast("int").alias("w"),
                     (F.col("l_suppkey") % 50 + 1).cast("int").alias("h"))


def fx_raster(spark, sf_dir) -> DataFrame:
    """Gray 8x8 image per embedding: pixel p -> (p div 8, p % 8)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    x = e.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
    return x.select("image_id", (F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"),
                    F.floor((F.col("e").cast("double") + 1) * 127).cast("int").alias("v"))


def fx_rgb(spark, sf_dir) -> DataFrame:
    """Colour (B,G,R) image of 4 pixels a row from each embedding; the last pixel's
    missing channels are 0."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    short = F.pmod(-F.size("embedding"), F.lit(3))
    whole = F.concat("embedding", F.array_repeat(F.lit(-1.0).cast("float"), short))
    x = e.select(F.col("vec_id").alias("image_id"), F.posexplode(whole).alias("p", "e"))
    return x.select("image_id", (F.col("p") / 12).cast("int").alias("y"), ((F.col("p") / 3).cast("int") % 4).alias("x"),
                    (F.col("p") % 3).cast("int").alias("c"),
                    F.floor((F.col("e").cast("double") + 1) * 127).cast("int").alias("v"))


def fx_theta(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    x = e.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("rank", "e"))
    return x.select("image_id", F.col("rank").cast("int").alias("rank"),
                    ((F.col("e").cast("double") + 1) * 1.5).alias("theta"))


def fx_dims(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    known = F.col("p_size") <= 45
    return p.select(F.col("p_partkey").alias("image_id"),
                    F.when(known, F.col("p_size") * 10).cast("int").alias("h"),
                    F.when(known, F.col("p_size") * 7).cast("int").alias("w"),
                    F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4), F.lit(2)),
                                 (F.col("p_partkey") % 4 + 1).cast("int")).alias("channels"))


def fx_params(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey")
    return n.select(
        k.alias("id"),
        F.when(k % 2 == 0, (k * 10).cast("double")).alias("det_limit_side_len"),
        F.when(k % 3 == 0, (k / 100.0)).alias("det_db_thresh"),
        F.when(k % 4 == 0, (k / 50.0)).alias("text_det_db_thresh"),
        F.when(k % 5 == 0, (k / 20.0)).alias("text_det_thresh"),
        F.when(k % 2 == 1, F.lower("n_name")).alias("rec_model_name"),
        F.when(k % 7 == 0, (k * 5).cast("double")).alias("text_det_limit_side_len"))


# ------------------------------------------------------------------ spelling
def _benchmark_words(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return b.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), 0)).alias("word"))


def fx_lexicon_words(spark, sf_dir) -> DataFrame:
    """Two lexicons: the words of ``benchmark``, and those of its even items, each also
    written twice (long words)."""
    w = _benchmark_words(spark, sf_dir)
    even = w.where(F.col("item_id") % 2 == 0)
    return (w.select(F.lit("en").alias("lang"), "word")
            .unionByName(even.select(F.lit("id").alias("lang"), F.explode(F.array("word", F.concat("word", "word"))).alias("word"))))


def fx_words(spark, sf_dir) -> DataFrame:
    """All lexicon words and misspelt tokens (letters 2,3 swapped + 'x')."""
    w = fx_lexicon_words(spark, sf_dir).select("word").distinct()
    tok = F.concat(F.substring("word", 1, 1), F.substring("word", 3, 1), F.substring("word", 2, 1),
                   F.expr("substring(word, 4)"), F.lit("x"))
    return w.select("word", tok.alias("tok"))
