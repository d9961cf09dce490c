"""Benchmark decontamination by a distributed positional inverted index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased. A phrase is ``WINDOW`` consecutive words of a benchmark item (a
shorter item is one phrase).

1. ``term_frequencies`` counts the benchmark's terms over all documents.
2. ``anchors`` takes each phrase's rarest terms; a phrase with a term that no
   document holds cannot occur.
3. ``build_index`` stores the postings (document, position) of those terms;
   postings of a phrase's rarest term also keep the words around them.
4. ``phrase_matches`` shifts each posting by its term's offset and intersects
   the lists on (document, phrase, start); what is left is compared word by
   word. ``proximity_matches`` asks only that the terms stand close together.

DataFrame functions only. Terms are joined by 64-bit hashes (a collision could
only merge two lists); the comparison is of the words themselves, so the result
is exact. No list is cut: a phrase of frequent words has long lists.

Nulls: a null text has no words. Equal rows get equal results; rows that share
a doc_id but differ in text are told apart by the text's hash. Empty tables
give no matches. Only doc_id, text and item_id are read, so further columns
cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_side, stored, text_or_empty

WINDOW = 10
ANCHORS = 2
# A-Z to lower case, all other ASCII but a-z and 0-9 to blanks, in one pass over the text.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and c != 0x20)
FROM = string.ascii_uppercase + SEPARATORS
TO = string.ascii_lowercase + " " * len(SEPARATORS)
DOC = ["doc_id", "text_hash"]


def words_of(column: str = "text") -> Column:
    return F.array_remove(F.split(F.translate(text_or_empty(column), FROM, TO), " "), "")


def document_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of().alias("words"))


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase): the words of each window, joined by blanks."""
    items = benchmark.select("item_id", words_of().alias("words")).where(F.size("words") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))))
    return (items.select("item_id", "words", start.alias("start"))
            .select("item_id", F.array_join(F.slice("words", F.col("start"), F.lit(window)), " ").alias("phrase"))
            .distinct())


def phrase_terms(phrase_items: DataFrame) -> DataFrame:
    """(phrase, phrase_id, n_words, term, offset), each term (a hash) of a phrase at its first offset."""
    p = phrase_items.select("phrase").distinct().withColumn("words", F.split("phrase", " "))
    t = p.select("phrase", F.size("words").alias("n_words"), F.posexplode("words").alias("offset", "term"))
    return (t.groupBy("phrase", "n_words", F.xxhash64("term").alias("term")).agg(F.min("offset").alias("offset"))
            .withColumn("phrase_id", F.xxhash64("phrase")))


def term_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, frequency) over all documents for the given distinct terms that occur."""
    tokens = document_words(docs).select(F.explode("words").alias("token")).select(F.xxhash64("token").alias("term"))
    return tokens.join(small_side(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


def anchors(terms: DataFrame, frequencies: DataFrame, per_phrase: int = ANCHORS) -> DataFrame:
    """The rarest ``per_phrase`` terms of each phrase whose terms all occur:
    (phrase, phrase_id, n_words, term, offset, rarity from 1, n_anchors)."""
    t = terms.join(frequencies, "term", "left")
    w = Window.partitionBy("phrase")
    t = t.withColumn("missing", F.sum(F.col("frequency").isNull().cast("int")).over(w))
    t = t.where("missing = 0").withColumn("rarity", F.row_number().over(w.orderBy("frequency", "term")))
    t = t.where(F.col("rarity") <= per_phrase)
    return t.withColumn("n_anchors", F.max("rarity").over(w)).drop("frequency", "missing")


def build_index(docs: DataFrame, anchor_terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Postings (term, doc_id, text_hash, position from 0, around, around_at) of the
    given terms; ``around`` holds the words within reach of a phrase that the
    term leads, from position ``around_at`` on."""
    terms = anchor_terms.groupBy("term").agg(F.min("rarity").alias("best"))
    tokens = document_words(docs).select(*DOC, "words", F.posexplode("words").alias("position", "token"))
    reach = window - 1
    found = tokens.withColumn("term", F.xxhash64("token")).join(small_side(terms), "term")
    at = F.greatest(F.col("position") - reach, F.lit(0))
    around = F.array_join(F.slice("words", at + 1, F.col("position") - at + window), " ")
    return found.select("term", *DOC, "position", F.when(F.col("best") == 1, around).alias("around"), at.alias("around_at"))


def adjusted(index: DataFrame, anchor_terms: DataFrame) -> DataFrame:
    """Each posting as the start of each phrase that holds its term."""
    j = index.join(small_side(anchor_terms), "term")
    return j.withColumn("start", F.col("position") - F.col("offset"))


def phrase_matches(index: DataFrame, anchor_terms: DataFrame) -> DataFrame:
    """Exact occurrences (doc_id, text_hash, phrase, start, n_words), each once."""
    lists = adjusted(index, anchor_terms).where("start >= 0")
    spot = [*DOC, "phrase_id", "start"]
    common = (lists.select(*spot, "n_anchors", "rarity").distinct().groupBy(*spot, "n_anchors")
              .agg(F.count(F.lit(1)).alias("n")).where("n = n_anchors").select(*spot))
    lead = lists.where("rarity = 1").select(*spot, "phrase", "n_words", "around", F.col("around_at")).alias("a")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in spot]
    both = lead.join(common.alias("b"), on, "left_semi")
    begin = F.greatest(F.col("start") - F.col("around_at") + 1, F.lit(1))   # slice() rejects 0, also in rows filtered out later
    text = F.slice(F.split("around", " "), begin, F.col("n_words"))
    return both.where(F.array_join(text, " ") == F.col("phrase")).select(*DOC, "phrase", "start", "n_words").distinct()


def proximity_matches(index: DataFrame, anchor_terms: DataFrame, slop: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, phrase, start): places of a phrase's rarest term where each
    other anchor term, in any order, begins at most ``slop`` positions from where the
    phrase would have it. Rows meet on position cells of ``slop + 1``, never all with all."""
    lists = adjusted(index, anchor_terms).select(*DOC, "phrase", "rarity", "n_anchors", "start").distinct()
    cell = F.floor(F.col("start") / (slop + 1))
    lead = lists.where("rarity = 1").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("a")
    rest = lists.where("rarity > 1").withColumn("cell", cell).alias("b")
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*DOC, "phrase", "cell"]]
    near = lead.join(rest, [*keys, F.abs(F.col("a.start") - F.col("b.start")) <= slop])
    near = (near.select(*[F.col(f"a.{c}").alias(c) for c in [*DOC, "phrase", "n_anchors", "start"]], F.col("b.rarity").alias("r"))
            .distinct().groupBy(*DOC, "phrase", "n_anchors", "start").agg(F.count(F.lit(1)).alias("n")))
    alone = lists.where("n_anchors = 1")
    return near.where("n = n_anchors - 1").drop("n", "n_anchors").unionByName(alone.drop("rarity", "n_anchors"))


def hit_counts(matches: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_hit): words inside any occurrence, by a running right edge."""
    order = Window.partitionBy(*DOC).orderBy("start")
    spans = matches.groupBy(*DOC, "start").agg(F.max("n_words").alias("n_words"))
    end = F.col("start") + F.col("n_words")
    edge = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(edge, F.lit(0))), F.lit(0))
    return spans.withColumn("fresh", fresh).groupBy(*DOC).agg(F.sum("fresh").cast("long").alias("n_hit"))


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(exact matches, phrase -> item_id), both stored."""
    of_item = stored(phrases(benchmark, window), "phrases")
    terms = stored(phrase_terms(of_item), "phrase-terms")
    frequencies = stored(term_frequencies(docs, terms.select("term").distinct()), "term-frequencies")
    rare = stored(anchors(terms, frequencies), "anchors")
    index = stored(build_index(docs, rare, window), "postings")
    return stored(phrase_matches(index, rare), "phrase-matches"), of_item


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, item_ids (sorted as
    strings), contaminated."""
    matches, of_item = find_phrases(docs, benchmark, window)
    items = (matches.join(small_side(of_item), "phrase").select(*DOC, F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy(*DOC).agg(F.array_sort(F.collect_list("item")).alias("item_ids")))
    found = (hit_counts(matches).alias("h")
             .join(items.alias("i"), [F.col(f"h.{c}").eqNullSafe(F.col(f"i.{c}")) for c in DOC], "left")
             .select(*[F.col(f"h.{c}").alias(f"at_{c}") for c in DOC], "n_hit", "item_ids"))
    d = document_words(docs).select(*DOC, F.size("words").cast("long").alias("n_words"))
    d = d.join(found, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in DOC], "left")
    return d.select(*DOC, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` less the documents that hold a phrase of the benchmark; same columns."""
    matches, _ = find_phrases(docs, benchmark, window)
    bad = matches.select(*[F.col(c).alias(f"bad_{c}") for c in DOC]).distinct()
    packed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("whole_row"))
    bad = small_side(stored(bad, "contaminated"))
    return (packed.join(bad, [F.col(c).eqNullSafe(F.col(f"bad_{c}")) for c in DOC], "left_anti").select("whole_row.*"))
