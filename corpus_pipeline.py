"""The corpus pipeline: quality classifier, near-duplicates, benchmark
decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's docs. All but the last return the
columns of docs. Nulls, empty texts and repeated rows: as in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetext.llm import decontaminate, mixing, neardup, quality, sharding
from pagetext.llm.tables import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labelled ones selects."""
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near-duplicates: shingles of
    five words, similarity 0.8 or more."""
    return neardup.drop_near_duplicates(docs, shingle=5)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard, slot and grown_shard; copies get slots of their own."""
    return sharding.shuffle_into_shards(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontaminate", clean_of_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]

# Sampling, sketches and seeded shuffles have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
