"""Mixing sources to target weights.

Tokens (words) are summed per source; each source gets a share of all words by
weight, at most ``cap`` times its own size, the excess going to the others by
weight. The repetition rate of a source is target over size; a document is
emitted floor(rate) times, plus once more with probability equal to the
fraction, decided by a seeded hash of its doc_id, its text and its number among
the rows that share both and the source: rows that share an id (or have none)
decide apart from each other, and reruns agree.

Sources are ordered by code point with null (a source like any other) last;
weights repeat along that order. A null or empty text has size 0; equal rows
without words share their decision. A source without words has target and rate 0. Columns of
the input named like an added one (any case) are replaced; an empty table gives
an empty result.

A hot source costs nothing extra: sums are pre-aggregated before the shuffle
and the table of sources, whose row count is checked, is broadcast; beyond the
bound it is joined by shuffle (AQE splits a hot source). The targets order all
sources in one window, a row each. Repeated rows are counted by a digest of the
text; where there are any, they alone are numbered (in chunks, see ``tables``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import numbered_repeats, small_side, stored, text_or_empty, unused, without

WEIGHTS = (5, 2, 1)
CAP = 3.0
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """From (source, size) rows: source, source_size, target, rate; one row per source.

    Water filling: with sources in order of cap/weight, the level is
    (total - caps before) / (weight from here on); it rises while sources are
    capped and falls afterwards, so the wanted level is its maximum."""
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                            (rank % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - before) / rest)
    s = s.withColumn("target", F.least("most", F.max("level").over(Window.partitionBy()) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size")))
    return s.select("source", "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def uniform(doc_id: Column, number: Column, digest: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of a seeded MD5 of id, number and text digest."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), number.cast("string"), digest)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target and copies (0 to ``cap``)."""
    docs = without(docs, "size", "source_size", "target", "copies")
    rate, of, digest, number = (unused(docs, n) for n in ("rate", "of_source", "text_digest", "number"))
    sized = docs.withColumns({"size": word_count(), digest: F.md5(text_or_empty())})
    counted = stored(sized.groupBy("doc_id", "source", digest).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "mix-counts")
    targets = stored(source_targets(counted, weights, cap), "mix-targets")
    targets = small_side(targets.withColumnsRenamed({"source": of, "rate": rate}))
    repeats = counted.where("n > 1 and size > 0").select("doc_id", "source", digest, "n")
    joined = numbered_repeats(sized, repeats, ["doc_id", "source", digest], number)
    joined = joined.join(targets, F.col("source").eqNullSafe(F.col(of)), "left")
    whole = F.floor(F.col(rate))
    extra = (uniform(F.col("doc_id"), F.col(number), F.col(digest), seed) < F.col(rate) - whole).cast("long")
    return joined.withColumn("copies", whole + extra).drop(rate, of, digest, number)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its copies say, same columns."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("whole_row"))
    plan = mixing_plan(packed, weights, cap, seed).where(F.col("copies") > 0)
    again = plan.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select("whole_row.*")
