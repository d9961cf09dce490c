"""A2 latency report and A3 request metrics.

Exact order statistics without gathering a group in one task: equal values are
counted first, the distinct values are cut into disjoint half-open buckets at
quantiles of a mergeable sketch, the buckets' total weights (a few hundred rows
per group) give each bucket its offset, and a running weight inside the bucket
gives each value the ranks it covers. Ties collapse in the first step and a hot
group is split over its buckets; the sketch only places the cuts, so the result
is exact. One path for groups of every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default latency histogram bucket bounds (seconds).
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)

CUTS = 256                       # buckets per group


def p95_rank(n: Column) -> Column:
    """1-based lower rank j of the exclusive 95th percentile (clamped to 1..n-1)."""
    return F.least(F.greatest(F.floor(F.lit(19) * (n + 1) / 20), F.lit(1)), n - 1).cast("long")


def rank_spans(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value, n, lo, hi)``: each distinct value with the 1-based ranks
    ``lo..hi`` its rows hold in ascending order, and the group size ``n``."""
    weights = df.groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    cuts = weights.groupBy("g").agg(F.array_sort(F.array_distinct(
        F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 10 * CUTS))).alias("cuts"), F.sum("w").alias("n"))
    cuts = cuts.select(F.col("g").alias("cg"), "cuts", "n")
    placed = weights.join(cuts, F.col("g").eqNullSafe(F.col("cg")))
    # a value lies in the bucket of the cuts at or below it
    bucket = F.size(F.filter("cuts", lambda c: c <= F.col("v")))
    placed = placed.select("g", "v", "w", "n", bucket.alias("b"))
    totals = placed.groupBy("g", "b").agg(F.sum("w").alias("t"))
    before = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("g").alias("og"), F.col("b").alias("ob"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.join(offsets, F.col("g").eqNullSafe(F.col("og")) & (F.col("b") == F.col("ob")))
    hi = F.col("offset") + F.sum("w").over(inside)
    return run.select(F.col("g").alias(group), F.col("v").alias(value), "n", (hi - F.col("w") + 1).alias("lo"), hi.alias("hi"))


def latency_report(df: DataFrame, group: str = "endpoint", value: str = "seconds") -> DataFrame:
    """A2: count, median, exclusive p95 and throughput (count / total seconds,
    NULL where the total is 0) per group. A missing duration counts as 0.0."""
    x = df.select(group, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value))
    totals = x.groupBy(F.col(group).alias("tg")).agg(F.sum(value).alias("total"))
    spans = rank_spans(x, group, value)
    n, v = F.col("n"), F.col(value)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("lo") <= rank) & (rank <= F.col("hi")), v))
    j95 = p95_rank(n)
    d95 = F.lit(19) * (n + 1) - F.lit(20) * j95
    picks = spans.groupBy(group, "n").agg(
        at(F.floor((n + 1) / 2).cast("long")).alias("m_lo"), at(F.ceil((n + 1) / 2).cast("long")).alias("m_hi"),
        at(j95).alias("a_j"), at(j95 + 1).alias("a_j1"), at(F.lit(1)).alias("a_1"))
    p95 = F.when(n == 1, F.col("a_1")).otherwise((F.col("a_j") * (F.lit(20) - d95) + F.col("a_j1") * d95) / 20)
    return (picks.join(totals, F.col(group).eqNullSafe(F.col("tg")))
            .select(group, n.alias("count"), ((F.col("m_lo") + F.col("m_hi")) / 2).alias("p50"), p95.alias("p95"),
                    F.try_divide(n, F.col("total")).alias("throughput")))


def request_metrics(df: DataFrame, group: str = "endpoint", value: str = "seconds",
                    buckets: tuple[float, ...] = DEFAULT_BUCKETS) -> DataFrame:
    """A3: per group the request count, latency sum and the cumulative histogram
    (one row per bucket bound, ``+Inf`` as the last bound). One aggregation,
    partial on the map side; the long form is made from the aggregated rows."""
    aggs = [F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum")]
    aggs += [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).cast("long").alias(f"le_{i}")
             for i, b in enumerate(buckets)]
    wide = df.groupBy(group).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("bucket_count"))
                      for i, b in enumerate(buckets)],
                    F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return wide.select(group, "count", "sum", F.inline(cells))
