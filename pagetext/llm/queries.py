"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ctw, decontaminate, mixing, neardup, pii, prefixtrie, quality, sharding, tokenfile, tokens, toolcalls, topk
from .tables import table, text_or_empty


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixing_plan(docs).select("doc_id", "size", "source_size", "target",
                                           (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.personal_data(table(spark, sf_dir, "documents"))
    span = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(span, ",").alias("spans"),
                    F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_added"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.shuffle_into_shards(docs)
    return rows.select("doc_id", sharding.row_size().alias("size"),
                       F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
                       "shard", "slot", "grown_shard")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link_calls(toolcalls.derived_messages(table(spark, sf_dir, "conversations")))


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "log_weight", "gumbel_key", "selected")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_sharding": op5_sharding,
    "op6_topk": op6_topk,
    "op7_neardup": op7_neardup,
    "op8_tool_calls": op8_tool_calls,
    "op9_ctw": op9_ctw,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_file": op13_token_file,
}
