"""S8 lexicon files, S9 evaluation sets, K1 result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_table_path


def read_lexicon(spark: SparkSession, folder: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    """``<folder>/<lang>.txt``, one token per line -> ``(lang, word, freq)``.

    Missing language files are simply absent; frequencies are token counts
    (case-insensitive)."""
    df = spark.read.text(f"{folder.rstrip('/')}/*.txt").select(
        # <lang>.txt may be a file or a folder of part files
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt(/[^/]*)?$", 1).alias("lang"),
        F.lower(F.trim(F.col("value"))).alias("word"))
    if languages is not None:
        df = df.where(F.col("lang").isin(*languages))
    return word_freq(df.where(F.col("word") != ""))


def word_freq(words: DataFrame) -> DataFrame:
    """Lexicon frequencies (partial aggregation)."""
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("freq"))


def line_numbers(lines: DataFrame) -> DataFrame:
    """``(row_id, value)`` of a text scan (``spark.read.text``): 0-based line numbers in
    file order. Rows are numbered within their file split and stored, since another scan may
    be split otherwise; the splits' offsets are running sums over one small row per split."""
    rows = lines.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"),
                        F.monotonically_increasing_id().alias("i"), "value")
    path = new_table_path(lines.sparkSession, "line-rows")
    rows.write.parquet(path)
    rows = lines.sparkSession.read.schema(rows.schema).parquet(path)
    splits = rows.groupBy("f", "s").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("f", "s").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("f", "s", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(splits, ["f", "s"]).select((F.col("offset") + F.col("i") - F.col("first")).alias("row_id"), "value")


def read_eval_sets(spark: SparkSession, predictions_path: str, truth_path: str) -> tuple[DataFrame, DataFrame]:
    """predictions = one JSON array of responses; truth = JSON lines. Both need
    ``text``; the row id is the place in the array, the line number in the file. The
    array is one value of one task: for small files, else ``read_eval_lines``."""
    array = spark.read.text(predictions_path, wholetext=True).select(F.from_json("value", "array<struct<text:string>>").alias("a"))
    preds = array.select(F.posexplode("a").alias("row_id", "r")).select(F.col("row_id").cast("long").alias("row_id"), "r.text")
    truth = line_numbers(spark.read.text(truth_path)).select("row_id", F.get_json_object("value", "$.text").alias("text"))
    return preds, truth


def read_eval_lines(spark: SparkSession, predictions_path: str, truth_path: str) -> tuple[DataFrame, DataFrame]:
    """S9 at any size: predictions and truth both JSON lines, in one file or a folder of
    part files; the row id is the line number over the files in order."""
    def side(path: str) -> DataFrame:
        return line_numbers(spark.read.text(path)).select("row_id", F.get_json_object("value", "$.text").alias("text"))
    return side(predictions_path), side(truth_path)


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """K1: responses as UTF-8 JSON lines (or Parquet); folders are created."""
    df.write.mode("overwrite").format(fmt).save(path)
