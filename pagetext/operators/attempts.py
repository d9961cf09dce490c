"""First successful attempt per document.

Attempts are ordered (0 = initial run, then the retry variants). The first
attempt with non-empty text wins. Duration = initial attempt + the winner
(failed retries are not counted; a winning initial attempt is counted
once). Without a winner the initial attempt is kept.

One ``groupBy`` over fixed-width values finds the winner's number (partial
aggregation, no text in it); the text is joined by that number. Attempts of a
document have distinct numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_success(attempts: DataFrame, key: str = "doc_id", order: str = "ord",
                  text: str = "text", ms: str = "ms") -> DataFrame:
    ok = F.col(text).isNotNull() & (F.col(text) != "")
    g = attempts.groupBy(F.col(key).alias("won_key")).agg(
        F.coalesce(F.min(F.when(ok, F.col(order))), F.lit(0)).alias("won"),
        F.max(F.when(F.col(order) == 0, F.col(ms))).alias("first_ms"))
    j = attempts.join(g, (F.col(key) == F.col("won_key")) & (F.col(order) == F.col("won")))
    return j.select(key, F.col("won").cast("int").alias("winner"), text,
                    (F.col("first_ms") + F.when(F.col("won") != 0, F.col(ms)).otherwise(F.lit(0.0))).alias("duration_ms"))
