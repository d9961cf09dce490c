"""A4: language decision from detector candidates.

Candidates ``(doc, rank, code, prob)`` in detector order. Codes map to
'en'/'id' (others dropped). More than one distinct mapped code with
prob >= 0.25 -> 'mix'; else the first mapped candidate if its prob >= 0.4;
else the default. Documents with no mapped candidate fall back to the
heuristic (L1) on their text; blank text gives the default before any vote. One partial aggregation per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import detector_code, language_heuristic


def language_votes(candidates: DataFrame, texts: DataFrame, key: str = "doc_id",
                   default: str = "mix") -> DataFrame:
    mapped = candidates.select(key, "rank", detector_code(F.col("code")).alias("m"), "prob").where(
        F.col("m").isNotNull())
    g = mapped.groupBy(key).agg(
        F.size(F.collect_set(F.when(F.col("prob") >= 0.25, F.col("m")))).alias("strong"),
        F.min_by(F.struct("m", "prob"), F.col("rank")).alias("top"))
    decided = g.select(key, F.when(F.col("strong") > 1, F.lit("mix"))
                       .when(F.col("top.prob") >= 0.4, F.col("top.m"))
                       .otherwise(F.lit(default)).alias("voted"))
    t = texts.select(key, "text").join(decided, key, "left")
    blank = F.coalesce(F.regexp_replace("text", r"\s+", "") == "", F.lit(True))
    voted = F.when(~blank, F.col("voted"))
    return t.select(key, F.when(blank, F.lit(default)).otherwise(F.coalesce(voted, language_heuristic(F.col("text"), default))).alias("language"),
                    voted.isNotNull().alias("from_detector"))
