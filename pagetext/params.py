"""Job parameters (a frozen dataclass handed to jobs, not a table) and F4.

F4 ``alias_columns`` rewrites a parameter table that still uses the old
parameter names: per target column ``coalesce(new, old_1, old_2, ...)``,
the new name wins when present, among old names the first in the fixed
table order wins, and old columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Old parameter name -> new parameter name, in this order.
LEGACY_ALIASES = (
    ("det_limit_side_len", "text_det_limit_side_len"),
    ("det_limit_type", "text_det_limit_type"),
    ("det_db_unclip_ratio", "text_det_unclip_ratio"),
    ("det_db_box_thresh", "text_det_box_thresh"),
    ("det_db_thresh", "text_det_thresh"),
    ("text_det_db_thresh", "text_det_thresh"),
    ("rec_score_thresh", "text_rec_score_thresh"),
    ("det_model_name", "text_detection_model_name"),
    ("rec_model_name", "text_recognition_model_name"),
)

# File suffixes accepted by folder scans (S1) and batch runs.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".webp")
BATCH_SUFFIXES = (".png", ".jpg", ".jpeg", ".tiff", ".webp")

# Text the dummy engine produces and the handwriting warning.
DUMMY_TEXT = "dummy-ocr-output"
HANDWRITING_WARNING = "Handwriting recognition is experimental. Results may vary."


@dataclass(frozen=True)
class Params:
    languages: tuple[str, ...] = ("id", "en")
    min_confidence: float = 0.3
    engine: str = "paddle"
    ocr_version: str | None = "PP-OCRv5"
    max_file_size_mb: int = 20
    pdf_text: bool = True
    max_pdf_pages: int | None = None
    table_mode: bool = False
    handwriting_mode: bool = False
    handwriting_warning: str = HANDWRITING_WARNING
    use_spell_correction: bool = True
    default_language: str = "mix"
    image_suffixes: tuple[str, ...] = field(default=IMAGE_SUFFIXES)
    batch_suffixes: tuple[str, ...] = field(default=BATCH_SUFFIXES)

    @property
    def max_file_bytes(self) -> int:
        return self.max_file_size_mb * 1024 * 1024

    @property
    def primary_language(self) -> str:
        return self.languages[0] if self.languages else "en"

    @property
    def languages_str(self) -> str:
        return ",".join(self.languages)


def alias_columns(df: DataFrame) -> DataFrame:
    """fold old parameter columns into their new names; drop the old ones."""
    present = set(df.columns)
    targets: dict[str, list[str]] = {}
    for old, new in LEGACY_ALIASES:
        if old in present:
            targets.setdefault(new, []).append(old)
    out = df
    for new, olds in targets.items():
        sources = ([F.col(new)] if new in present else []) + [F.col(o) for o in olds]
        out = out.withColumn(new, F.coalesce(*sources) if len(sources) > 1 else sources[0])
    drop = [old for old, _ in LEGACY_ALIASES if old in present]
    return out.drop(*drop)
