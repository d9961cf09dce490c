"""Sizes, response metadata, text statistics, response record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params

META_SCHEMA = ("struct<source:string,path:string,image_size:array<int>,duration_ms:double,device:string,"
               "engine:struct<name:string,ocr_version:string,language:string>,pipeline:array<string>,"
               "engine_duration_ms:double,postprocess_ms:double,tables:array<struct<bbox:array<int>,cells:int>>,"
               "warnings:array<string>,page_index:int,source_pdf:string>")


def image_size(width: Column, height: Column) -> Column:
    """``[width, height]``; ``[0, 0]`` when the size is unknown."""
    known = width.isNotNull() & height.isNotNull() & (width >= 0) & (height >= 0)
    return F.when(known, F.array(width.cast("int"), height.cast("int"))).otherwise(
        F.array(F.lit(0), F.lit(0)))


def source_label(source: Column, path: Column) -> Column:
    """Provenance label: source, else path, else 'bytes'."""
    return F.coalesce(source, path, F.lit("bytes"))


def text_stats(text: Column, blocks: Column) -> dict[str, Column]:
    """characters, block count, empty-engine-text flag."""
    return {"text_chars": F.length(text).cast("long"),
            "blocks_n": F.coalesce(F.size(blocks), F.lit(0)).cast("long"),
            "empty_text": F.coalesce(F.regexp_replace(text, r"^\s+|\s+$", "") == "", F.lit(True))}


def attach_meta(params: Params, *, source: Column, path: Column, width: Column, height: Column,
                duration_ms: Column, device: Column, engine_name: Column, engine_language: Column,
                pipeline: Column | None = None, engine_duration_ms: Column | None = None,
                postprocess_ms: Column | None = None, tables: Column | None = None,
                page_index: Column | None = None, source_pdf: Column | None = None) -> Column:
    """the ``meta`` struct; the handwriting warning is appended when enabled."""
    warnings = F.array().cast("array<string>")
    if params.handwriting_mode:
        warnings = F.array_append(warnings, F.lit(params.handwriting_warning))
    null_d = F.lit(None).cast("double")
    return F.struct(
        source.cast("string").alias("source"), path.cast("string").alias("path"),
        image_size(width, height).alias("image_size"),
        duration_ms.cast("double").alias("duration_ms"), device.alias("device"),
        F.struct(engine_name.alias("name"), F.lit(params.ocr_version).cast("string").alias("ocr_version"),
                 engine_language.alias("language")).alias("engine"),
        (pipeline if pipeline is not None else F.array().cast("array<string>")).alias("pipeline"),
        (engine_duration_ms if engine_duration_ms is not None else null_d).alias("engine_duration_ms"),
        (postprocess_ms if postprocess_ms is not None else null_d).alias("postprocess_ms"),
        (tables if tables is not None else F.lit(None).cast("array<struct<bbox:array<int>,cells:int>>"))
        .alias("tables"),
        warnings.alias("warnings"),
        (page_index if page_index is not None else F.lit(None)).cast("int").alias("page_index"),
        (source_pdf if source_pdf is not None else F.lit(None)).cast("string").alias("source_pdf"))


def response_struct(df: DataFrame) -> DataFrame:
    """K2: the public record is exactly ``text, language, blocks, meta``."""
    return df.select("text", "language", "blocks", "meta")
