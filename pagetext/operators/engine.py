"""U1 pluggable recogniser (Arrow-batched) and U2 the dummy engine.

U1: the user supplies a factory returning an object with
``infer(image_bytes, languages) -> dict(text, blocks, language, device,
duration_ms)``. The factory is called once per partition inside
``mapInPandas``, so a heavy model is loaded once per task, not per row.

U2: the dummy engine as a pure column expression (no Python at all).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variants import TEXT_KEYS
from ..params import DUMMY_TEXT

BLOCK_SCHEMA = "array<struct<bbox:array<double>,text:string,confidence:double,block_id:int,line_id:int>>"
ENGINE_OUTPUT = (f"key string, text string, blocks {BLOCK_SCHEMA}, language string, device string, "
                 "duration_ms double, engine_name string, error string")


def run_engine(images: DataFrame, factory: Callable[[], object], languages: tuple[str, ...], name: str,
               key: str = "key", content: str = "content") -> DataFrame:
    """``images(key, content binary)`` -> engine output rows.

    A failing row is kept with ``error`` set (the caller decides between
    all-or-nothing and keep-going, C5/C6)."""
    langs = list(languages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for pdf in batches:
            rows = []
            for k, data in zip(pdf[key], pdf[content]):
                start = time.perf_counter()
                try:
                    out = engine.infer(data, langs)
                    rows.append({"key": k, "text": out.get("text", ""), "blocks": out.get("blocks", []),
                                 "language": out.get("language"), "device": out.get("device", "cpu"),
                                 "duration_ms": float(out.get("duration_ms",
                                                              (time.perf_counter() - start) * 1000)),
                                 "engine_name": name, "error": None})
                except Exception as exc:  # keep the row, record the failure
                    rows.append({"key": k, "text": None, "blocks": None, "language": None, "device": None,
                                 "duration_ms": None, "engine_name": name, "error": f"{type(exc).__name__}: {exc}"})
            yield pd.DataFrame(rows, columns=["key", "text", "blocks", "language", "device", "duration_ms",
                                              "engine_name", "error"])

    return images.select(F.col(key).alias("key"), F.col(content)).mapInPandas(run, ENGINE_OUTPUT)


def dummy_output(width: Column, height: Column, languages: Column) -> Column:
    """Constant recognition result for an image of the given size."""
    block = F.struct(
        F.array(F.lit(0.0), F.lit(0.0), width.cast("double"), height.cast("double")).alias("bbox"),
        F.lit(DUMMY_TEXT).alias("text"), F.lit(0.5).alias("confidence"),
        F.lit(0).alias("block_id"), F.lit(0).alias("line_id"))
    return F.struct(F.lit(DUMMY_TEXT).alias("text"), F.array(block).alias("blocks"),
                    F.coalesce(F.get(languages, 0), F.lit("en")).alias("language"),
                    F.lit("cpu").alias("device"), F.lit(0.0).alias("duration_ms"),
                    F.lit("dummy").alias("engine_name"))


def found_texts(value: object) -> Iterator[str]:
    """The texts of a stored payload, in reading order."""
    if isinstance(value, dict):
        own = next((value[k] for k in TEXT_KEYS if isinstance(value.get(k), str) and value[k]), None)
        if own is not None:
            yield own
        else:
            for x in value.values():
                yield from found_texts(x)
    elif isinstance(value, list):
        if len(value) > 1 and isinstance(value[1], list) and value[1] and isinstance(value[1][0], str):
            yield value[1][0]
        else:
            for x in value:
                yield from found_texts(x)


class JsonPayloadEngine:
    """Example engine for U1: the 'image' bytes hold a stored recognition payload of any
    shape; text = its texts joined by newline. Replays engine output through the
    same interface."""

    def infer(self, data: bytes, languages: list[str]) -> dict:
        try:
            payload = json.loads(bytes(data).decode("utf-8"))
        except (ValueError, RecursionError):
            raise ValueError("payload is no JSON") from None
        return {"text": "\n".join(t for t in found_texts(payload) if t), "blocks": [],
                "language": languages[0] if languages else "en", "device": "cpu"}
