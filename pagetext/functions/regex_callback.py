"""Regex replacement with a per-match function, in Catalyst expressions.

Spark's ``regexp_replace`` only takes a replacement template. A callback is
expressed by interleaving the text between matches with the transformed
matches: ``split(s, re, -1)`` gives the n+1 gaps, ``regexp_extract_all``
the n matches, and ``zip_with`` + ``array_join`` stitches them together.
Everything stays JVM-side (codegen-friendly higher-order functions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_matches(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match ``m`` of ``pattern`` in ``text`` by ``fn(m)``."""
    gaps = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), fn)
    stitched = F.array_join(
        F.zip_with(gaps, matches, lambda gap, m: F.concat(F.coalesce(gap, F.lit("")),
                                                          F.coalesce(m, F.lit("")))),
        "")
    # texts without a match (and NULL) stay as they are: one scan instead of two
    return F.when(text.rlike(pattern), stitched).otherwise(text)


def group(match: Column, pattern: str, idx: int) -> Column:
    """Capture group ``idx`` of a single match (re-anchored on the match)."""
    return F.regexp_extract(match, pattern, idx)
