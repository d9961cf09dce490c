"""Document pages and merging embedded with recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import language_heuristic
from ..params import Params
from . import assemble, cache

OCR_SEPARATOR = "\n--- OCR ---\n"


def page_table(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One row per page, missing embedded text -> '', first ``max_pages`` pages."""
    out = pages.withColumn("embedded_text", F.coalesce(F.col("embedded_text"), F.lit("")))
    if max_pages is not None:
        out = out.where(F.col("page_index") < max_pages)
    return out


def merge_page_text(ocr_pages: DataFrame, embedded: DataFrame, pdf_text: bool = True,
                    keys: tuple[str, str] = ("pdf", "page_index")) -> DataFrame:
    """Page text = embedded + separator + OCR text when embedded text is
    non-empty and ``pdf_text`` is on, else the OCR text (even when empty)."""
    j = ocr_pages.join(embedded.select(*keys, "embedded_text"), list(keys), "left")
    use = F.lit(pdf_text) & F.coalesce(F.col("embedded_text") != "", F.lit(False))
    return j.withColumn("text", F.when(use, F.concat(F.col("embedded_text"), F.lit(OCR_SEPARATOR),
                                                     F.col("ocr_text"))).otherwise(F.col("ocr_text")))


def merge_text_safe(ocr_text: Column, pdf_text: Column) -> Column:
    """No embedded text -> OCR text; no OCR text -> embedded; else both."""
    return (F.when(pdf_text.isNull() | (pdf_text == ""), ocr_text)
            .when(ocr_text.isNull() | (ocr_text == ""), pdf_text)
            .otherwise(F.concat(pdf_text, F.lit(OCR_SEPARATOR), ocr_text)))


def page_responses(pages: DataFrame, stored: DataFrame, compute, params: Params, now: Column | None = None) -> DataFrame:
    """The pages ``(pdf, page_index, embedded_text, content)`` as responses: page ->
    cache by content -> engine for the misses -> merge with the embedded text ->
    ``text, language, blocks, meta`` with page_index and source_pdf."""
    p = page_table(pages, params.max_pdf_pages).withColumn("page_id", F.struct("pdf", "page_index"))
    inputs = p.select("page_id", F.col("content").alias("text")).withColumn("key", cache.content_key(F.col("text")))
    results, _ = cache.get_or_set(inputs, stored, compute, order="page_id", now=now)
    read = results.select("page_id.*", F.col("result_text").alias("ocr_text"), "engine_name")
    merged = merge_page_text(read, p.select("pdf", "page_index", "embedded_text"), pdf_text=params.pdf_text)
    merged = merged.withColumn("language", language_heuristic(F.col("text"), params.default_language))
    null = F.lit(None)
    meta = assemble.attach_meta(params, source=null, path=F.col("pdf").cast("string"), width=null, height=null, duration_ms=null,
                                device=F.lit("cpu"), engine_name=F.col("engine_name"), engine_language=F.lit(params.primary_language),
                                page_index=F.col("page_index"), source_pdf=F.concat(F.col("pdf").cast("string"), F.lit(".pdf")))
    blocks = F.array().cast("array<struct<bbox:array<double>,text:string,confidence:double,block_id:int,line_id:int>>")
    return merged.withColumns({"blocks": blocks, "meta": meta}).select("text", "language", "blocks", "meta")
