"""Sharding: two-pass external shuffle.

Pass 1 scatters the rows by seeded hashes: first to a shard, then to one of the
shard's buckets, each of about ``bucket_bytes``. Pass 2 sorts each bucket into
a defined order, applies a seeded Fisher-Yates shuffle and numbers the rows.
A shard is the sequence of its buckets.

Law ``key``: doc_id and the number of shards alone decide the shard, by
rendezvous hashing (highest random weight): one more shard takes rows only into
itself. A third of the rows may share a doc_id (or have none): they share a
shard, which then has more buckets, over which the row hash spreads them. Wholly
equal rows of more than a bucket's bytes are numbered first, and the number
spreads them.

Nulls: a null text has no bytes; a null doc_id is a key like any other. Equal
rows keep their own slots. An empty table gives an empty result. A column of
the input that has the name of an added column (any case) is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import numbered_repeats, quoted, row_hash, stored, text_or_empty, unused, without

SHARDS = 40
BUCKET_BYTES = 16 << 20
SEED = 20240229
ROW_OVERHEAD = 16


def shard_key(doc_id: Column, n_shards: int, seed: int = SEED) -> tuple[Column, Column]:
    """(shard of ``n_shards``, shard of ``n_shards + 1``) by rendezvous hashing."""
    weight = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.xxhash64(F.lit(seed), doc_id, i))
    best = F.array_max(weight)
    shard = (F.array_position(weight, best) - 1).cast("int")
    newcomer = F.xxhash64(F.lit(seed), doc_id, F.lit(n_shards))
    return shard, F.when(newcomer > best, F.lit(n_shards)).otherwise(shard).cast("int")


def row_size(column: str = "text") -> Column:
    """UTF-8 bytes of the text plus a fixed overhead."""
    return (F.octet_length(text_or_empty(column)) + ROW_OVERHEAD).cast("long")


def shuffle_into_shards(docs: DataFrame, n_shards: int = SHARDS, *, bucket_bytes: int = BUCKET_BYTES,
                        seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` with ``shard``, ``slot`` (gapless from 0 in each shard)
    and ``grown_shard`` (the shard if there were one more)."""
    docs = without(docs, "shard", "slot", "grown_shard")
    bucket, tie, first, copy = (unused(docs, n) for n in ("bucket", "row_tie", "first_slot", "copy_number"))
    shard, grown = shard_key(F.col("doc_id"), n_shards, seed)
    placed = docs.withColumns({tie: row_hash(docs), "shard": shard, "grown_shard": grown})

    equal = placed.groupBy("doc_id", tie, "shard").agg(F.count(F.lit(1)).alias("n"), F.sum(row_size()).alias("row_bytes"))
    equal = stored(equal, "shard-equal-rows")
    # one row per shard, a number set by a parameter: safe on the driver
    sizes = equal.groupBy("shard").agg(F.sum("row_bytes").alias("n")).collect()
    buckets = [1] * n_shards
    for r in sizes:
        buckets[r["shard"]] = max(1, -(-int(r["n"]) // bucket_bytes))
    of_shard = F.element_at(F.array(*[F.lit(b) for b in buckets]), F.col("shard") + 1)
    heavy = equal.where((F.col("n") > 1) & (F.col("row_bytes") > bucket_bytes)).select("doc_id", tie, "n")
    placed = numbered_repeats(placed, heavy, ["doc_id", tie], copy)
    placed = placed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col(quoted(tie)), F.col(copy)),
                                              of_shard).cast("int")).drop(copy)
    counts = placed.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("of_shard"), F.col(bucket).alias("of_bucket"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias(first))

    kept = [*docs.columns]
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()),
                           T.StructField("slot", T.LongType()), T.StructField("grown_shard", T.IntegerType())])

    def fisher_yates(key, rows: pa.Table, start: pa.Table) -> pa.Table:
        n = rows.num_rows
        ids = rows.column("doc_id").combine_chunks()
        order = np.lexsort((rows.column(tie).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                            ids.fill_null(0).to_numpy(zero_copy_only=False)))
        np.random.default_rng([seed, key[0].as_py(), key[1].as_py()]).shuffle(order)
        out = rows.select(kept).take(pa.array(order))
        at = start.column(first)[0].as_py()
        for name, values in (("shard", rows.column("shard").take(pa.array(order))), ("slot", pa.array(np.arange(at, at + n))),
                             ("grown_shard", rows.column("grown_shard").take(pa.array(order)))):
            out = out.append_column(name, values)
        return out

    return (placed.groupBy("shard", bucket).cogroup(starts.groupBy("of_shard", "of_bucket"))
            .applyInArrow(fisher_yates, schema))


def write_shards(shards: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    shards.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
