"""ST1: incremental ingest of new documents into the result cache.

``readStream`` over a file source (``maxFilesPerTrigger`` bounds each
micro-batch), ``foreachBatch`` hashes the rows, skips keys already stored,
normalises the rest and appends them to the store. The store and the checkpoint
are the caller's folders: a second start goes on where the first ended. Replaying
a micro-batch after a failure is harmless, since the anti-join with the stored
keys makes the write idempotent by key. The store is partitioned by the first
two hex digits of the key; a micro-batch reads only the partitions it needs and adds
at most one file to each.
A stored result of the dummy engine does not count (C4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import language_heuristic
from ..functions.normalize import normalize_frame
from ..operators.cache import content_key, dedupe_content, evict_dummy, least_per_key

STORE_SCHEMA = "key string, text string, language string, engine_name string, doc_id long, prefix string"


def read_store(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).parquet(store)


def _process(batch: DataFrame, store: str) -> None:
    spark = batch.sparkSession
    rows = batch.select("doc_id", "text", content_key(F.col("text")).alias("key"))
    prefix = F.substring("key", 1, 2).alias("prefix")
    prefixes = [r["prefix"] for r in rows.where("key IS NOT NULL").select(prefix).distinct().collect()]     # 256 at most
    known = evict_dummy(read_store(spark, store).where(F.col("prefix").isin(prefixes))).select("key")
    # which row stands for a key is settled on (key, doc_id); the texts move to it once
    fresh = rows.select("key", "doc_id").join(known, "key", "left_anti")
    fresh = dedupe_content(rows, least=least_per_key(fresh))
    out = normalize_frame(fresh.withColumn("language", language_heuristic(F.col("text"))))
    # a prefix is written by one task: one file, not one from each task
    (out.select("key", "text", "language", F.lit("stream").alias("engine_name"), "doc_id", prefix).repartition("prefix")
     .write.mode("append").partitionBy("prefix").parquet(store))


def stream_ingest(spark: SparkSession, source_glob: str, schema: str, store: str, checkpoint: str,
                  files_per_trigger: int = 1000) -> None:
    """Ingest what has come to the source since the last run on this checkpoint."""
    spark.createDataFrame([], STORE_SCHEMA).write.mode("append").partitionBy("prefix").parquet(store)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_glob).select("doc_id", "text"))
    q = (stream.writeStream.foreachBatch(lambda b, _id: _process(b, store))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
