"""ST2: running request count and latency histogram per endpoint.

A streaming aggregation in ``complete`` mode; ``foreachBatch`` writes each
micro-batch's full result as a version of its own below the caller's folder, so
a reader always finds a whole one; the last equals the batch report (A3). The
checkpoint is the caller's folder, too.

``stream_windows`` is the form that goes on for days: counts per endpoint and
event-time window in ``append`` mode. A window is written once, when the
watermark has passed its end, and leaves the state; rows that come for it later
are dropped. Each micro-batch writes a folder named by its number, so a batch
that is run again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import DEFAULT_BUCKETS


def read_metrics(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest version."""
    versions = spark.read.parquet(out_path)
    return versions.where(F.col("version") == versions.select(F.max("version")).scalar()).drop("version")


def stream_metrics(spark: SparkSession, source_glob: str, schema: str, out_path: str, checkpoint: str,
                   files_per_trigger: int = 1000) -> None:
    ev = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_glob)
          .select(F.col("event_type").alias("endpoint"), (F.col("value") / 100.0).alias("seconds")))
    aggs = [F.count(F.lit(1)).alias("count"), F.sum("seconds").alias("sum")]
    aggs += [F.sum(F.when(F.col("seconds") <= b, 1).otherwise(0)).cast("long").alias(f"le_{i}")
             for i, b in enumerate(DEFAULT_BUCKETS)]
    running = ev.groupBy("endpoint").agg(*aggs)

    def emit(batch: DataFrame, batch_id: int) -> None:
        cells = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("bucket_count"))
                          for i, b in enumerate(DEFAULT_BUCKETS)],
                        F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
        batch.select("endpoint", "count", "sum", F.inline(cells)).write.mode("overwrite").parquet(f"{out_path}/version={batch_id}")

    q = (running.writeStream.outputMode("complete").foreachBatch(emit)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def windowed_metrics(events: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Per endpoint and event-time window, with a watermark for late data."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window), "endpoint")
            .agg(F.count(F.lit(1)).alias("count"), F.sum("seconds").alias("sum")))


def stream_windows(spark: SparkSession, source_glob: str, schema: str, out_path: str, checkpoint: str, *, window: str = "5 minutes",
                   watermark: str = "10 minutes", files_per_trigger: int = 1000) -> list[dict[str, int]]:
    """ST2 in event time over all files there are. Returns, for each of the last micro-batches,
    its number, the rows in its state and the late (window, endpoint) groups it dropped."""
    ev = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_glob)
          .select("ts", F.col("event_type").alias("endpoint"), (F.col("value") / 100.0).alias("seconds")))

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    q = (windowed_metrics(ev, window, watermark).writeStream.outputMode("append").foreachBatch(emit)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return [{"batch": p.batchId, "state_rows": sum(o.numRowsTotal for o in p.stateOperators),
             "late_groups": sum(o.numRowsDroppedByWatermark for o in p.stateOperators)} for p in q.recentProgress]


def read_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """All closed windows: window, endpoint, count, sum."""
    return spark.read.parquet(out_path).drop("batch")
