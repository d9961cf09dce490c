"""A check that belongs to the rows of a table, not to one of its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """``df`` as it is, if every row passes; a row that does not (false or null) ends the
    job with ``message``. It is a filter, so it runs whatever columns are read, also for a count."""
    return df.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
