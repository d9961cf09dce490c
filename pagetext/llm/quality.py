"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (Xie et al. 2023, data selection via
importance resampling): a bag-of-features model of the target, documents
labelled good, and one of the raw corpus, all documents. A document's log
importance weight is the sum over its n features of ln(target / raw), times
``EXCERPT`` / (``EXCERPT`` + n): one rule for all lengths, under which long
documents compete by their mean and do not win or lose by length alone.
Selection is Gumbel top-k: that weight plus seeded Gumbel noise, the ``k``
largest stay.

Features: runs of word bytes (letters, digits, non-ASCII) and runs of other
visible bytes, A-Z lower-cased, and pairs of neighbours, hashed into
``BUCKETS``; a token that repeats its predecessor gives one common feature.

Parameters. ``LABELLED``: at most so many labelled documents are used, those of
smallest hash; one half makes the target model, the other sets ``k`` when it is
not given: the number of documents whose key reaches the level that parts the
held-back good documents from the bad ones at the least cost, a share of good
ones lost counting ``GOOD_COST`` times a share of bad ones kept. Without bad
ones it is the level that all but ``CLEAN_LOSS`` of the good ones reach, less
``MARGIN`` nats. The raw model, the weights and the selection cover all documents.

A document labelled good but toxic is neither target nor held back. A null or
empty text has weight 0. Equal rows share their noise; documents tied
with the k-th key all stay. A doc_id with several labels counts as good only if
all say so. Without good labels nothing is rejected. Only doc_id and text are
read; a column of docs named like an added one cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import IN_WORD, LOWER, U64, chunks, class_spans, flat, mix, span_hashes
from .tables import stored

BUCKETS = 10_000
LABELLED = 20_000
CLEAN_LOSS = 0.002
MARGIN = 3.0
GOOD_COST = 10.0
EXCERPT = 64
SEED = 23
SMOOTHING = 1.0

KIND = np.where(IN_WORD, 2, 0).astype(np.uint8)
KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
PAIR, REPEAT = U64(0xD6E8FEB86659FD93), U64(0x2545F4914F6CDD1D)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature bucket, text number) of all texts of a chunk."""
    data = LOWER[data]
    starts, ends, text = class_spans(data, offsets, KIND[data])
    h = span_hashes(data, starts, ends)
    inside = text[1:] == text[:-1]
    pair = np.where(h[1:] == h[:-1], REPEAT, mix(h[:-1] * PAIR + h[1:]))[inside]
    return (np.concatenate([h, pair]) % U64(BUCKETS)).astype(np.int64), np.concatenate([text, text[1:][inside]])


def labelled_sample(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, good, calibrates): at most ``limit`` labelled documents."""
    known = (labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.min("quality") > 0).alias("good"), F.coalesce(F.max("toxic") > 0, F.lit(False)).alias("toxic"))
             .where("not (good and toxic)").drop("toxic"))
    dice = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    return known.orderBy(dice, "doc_id").limit(limit).withColumn("calibrates", F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id")), F.lit(2)) == 1)


def feature_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target): feature counts over all documents and over the target's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in chunks(batches, "text"):
            bucket, text = features(*flat(b.column("text")))
            raw += np.bincount(bucket, minlength=BUCKETS)
            wanted = np.array(b.column("in_target").to_pylist(), dtype=bool)
            target += np.bincount(bucket[wanted[text]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])
    each = docs.select("text", "in_target").mapInArrow(run, "bucket long, raw long, target long")
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """ln(target / raw) per bucket; the driver gets at most ``BUCKETS`` rows."""
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() <= BUCKETS * SMOOTHING:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order."""
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, text_hash, label columns, log_weight, gumbel_key, key_order of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            bucket, text = features(*flat(b.column("text")))
            weight = np.bincount(text, weights=ratios[bucket], minlength=b.num_rows).astype(float)
            u = (mix(b.column("dice").to_numpy().view(U64)) >> U64(12)).astype(float) / 2.0 ** 52 + 2.0 ** -53
            size = np.bincount(text, minlength=b.num_rows)
            weight *= EXCERPT / (EXCERPT + size)
            key = weight - np.log(-np.log(u))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("doc_id", "text_hash", "good", "calibrates")], pa.array(weight), pa.array(key), pa.array(sortable(key))],
                names=["doc_id", "text_hash", "good", "calibrates", "log_weight", "gumbel_key", "key_order"])
    d = docs.select("doc_id", "text_hash", "good", "calibrates", F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text_hash")).alias("dice"), "text")
    return d.mapInArrow(run, "doc_id long, text_hash long, good boolean, calibrates boolean, log_weight double, "
                             "gumbel_key double, key_order long")


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a long column by radix selection: four counts of at most
    65,536 groups each; None where there are fewer rows."""
    u = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        rows = values if prefix is None else values.where(F.shiftrightunsigned(u, shift + 16) == prefix)
        part = F.shiftrightunsigned(u, shift).bitwiseAND(F.lit(0xFFFF)).alias("part")
        groups = sorted(rows.groupBy(part).count().collect(), key=lambda r: -r["part"])
        for r in groups:
            if left <= r["count"]:
                break
            left -= r["count"]
        else:
            return None
        prefix = r["part"] if prefix is None else (prefix << 16) | r["part"]
    return ((prefix ^ (1 << 63)) + (1 << 63)) % (1 << 64) - (1 << 63)


def parting_level(good: np.ndarray, bad: np.ndarray, clean_loss: float, margin: float) -> float:
    """The key from which documents stay, half way to the next labelled document below it."""
    if not len(bad):
        return float(np.quantile(good, clean_loss)) - margin
    good, bad = np.sort(good), np.sort(bad)
    levels = np.unique(np.concatenate([good, bad]))
    cost = GOOD_COST * np.searchsorted(good, levels) / len(good) + 1 - np.searchsorted(bad, levels) / len(bad)
    at = int(np.argmin(cost))
    return float((levels[at - 1] + levels[at]) / 2 if at else levels[at] - margin)


def calibrated_count(scored: DataFrame, clean_loss: float = CLEAN_LOSS, margin: float = MARGIN) -> int:
    """How many documents reach the level of the held-back labelled ones (at most LABELLED rows come to the driver)."""
    dice = F.xxhash64(F.lit(SEED + 2), F.col("doc_id"), F.col("text_hash"))      # repeated ids can make more rows than labels
    held = scored.where("calibrates").orderBy(dice, "gumbel_key").limit(LABELLED).select("good", "gumbel_key").collect()
    good = np.array([r["gumbel_key"] for r in held if r["good"]])
    if not len(good):
        return scored.count()
    level = parting_level(good, np.array([r["gumbel_key"] for r in held if not r["good"]]), clean_loss, margin)
    return scored.where(F.col("gumbel_key") >= level).count()


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """One row per document: doc_id, text_hash, log_weight, gumbel_key, selected."""
    sample = stored(labelled_sample(labels), "labelled").withColumnRenamed("doc_id", "labelled_id")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    # at most LABELLED rows, a parameter: safe to broadcast
    d = d.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"), "left").drop("labelled_id")
    d = d.withColumn("in_target", F.coalesce(F.col("good") & ~F.col("calibrates"), F.lit(False)))
    scored = stored(weights(d, log_ratios(feature_counts(d))), "importance")
    if k is None:
        k = calibrated_count(scored)
    least = kth_largest(scored, "key_order", k) if k > 0 else None
    selected = F.lit(k > 0) if least is None else F.col("key_order") >= least
    return scored.select("doc_id", "text_hash", "log_weight", "gumbel_key", selected.alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """``docs`` less the documents that resampling rejects; same columns."""
    from .neardup import IDS_BROADCAST
    from .tables import small_side
    out = resample(docs, labels, k).where("not selected").select(F.col("doc_id").alias("out_id"), F.col("text_hash").alias("out_hash")).distinct()
    out = small_side(stored(out, "rejected"), IDS_BROADCAST)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("whole_row"))
    on = [F.col("doc_id").eqNullSafe(F.col("out_id")), F.col("text_hash") == F.col("out_hash")]
    return packed.join(out, on, "left_anti").select("whole_row.*")
