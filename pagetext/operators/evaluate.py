"""Pair predictions with truths and score them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edit_distance import py_split
from .guard import required
from .long_pairs import with_distance


def pair_eval(preds: DataFrame, truths: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Positional pairing by an explicit row id. Unequal counts abort the job: a
    row without partner raises, whatever is read of the result (no driver-side count).
    A null text is a text that is missing, not a missing partner."""
    p = preds.select(F.col(row_id), F.col("text").alias("hyp"), F.lit(True).alias("has_hyp"))
    t = truths.select(F.col(row_id), F.col("text").alias("ref"), F.lit(True).alias("has_ref"))
    j = p.join(t, row_id, "full_outer")
    paired = required(j, F.col("has_hyp") & F.col("has_ref"), F.lit("a prediction or a truth has no partner"))
    return paired.select(row_id, "ref", "hyp")


def score_pairs(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", rates: tuple[str, ...] = ("cer", "wer")) -> DataFrame:
    """Per pair: CER over characters, WER over whitespace tokens, for texts of any length
    (a pair too long for one task is cut into cells). Empty truths count as one."""
    out = pairs
    for rate in rates:
        size = F.length(ref) if rate == "cer" else F.size(py_split(F.col(ref)))
        out = with_distance(out, ref, hyp, rate, tokens=rate == "wer")
        out = out.withColumn(rate, F.col(rate) / F.greatest(F.lit(1), size))
    return out


def mean_cer_wer(scored: DataFrame) -> DataFrame:
    """A1: macro means (per-document rates averaged, not pooled)."""
    return scored.agg(F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"),
                      F.count(F.lit(1)).alias("n"))
