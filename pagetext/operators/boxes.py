"""F2 box filter and A5 table summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_AREA = 500


def box_filter(boxes: DataFrame, min_area: int = MIN_AREA) -> DataFrame:
    """``(x, y, w, h)`` -> ``(x1, y1, x2, y2)``, boxes under ``min_area`` dropped."""
    keep = boxes.where(F.col("w") * F.col("h") >= min_area)
    others = [c for c in boxes.columns if c not in ("x", "y", "w", "h")]
    return keep.select(*others, F.col("x").alias("x1"), F.col("y").alias("y1"),
                       (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))


def table_summary(boxes: DataFrame, image: str = "image_id", order: str = "box_no") -> DataFrame:
    """A5: one row per image with the list of ``{bbox, cells}`` of its kept boxes in
    ``order``; ``cells`` is the image's kept-box count. The list is the response
    field itself, so it is as long as one image's boxes."""
    one = F.struct(F.col(order).alias("o"), F.array("x1", "y1", "x2", "y2").alias("bbox"))
    g = box_filter(boxes).groupBy(image).agg(F.array_sort(F.collect_list(one)).alias("b"))
    cells = F.size("b").cast("long")
    return g.select(image, F.transform("b", lambda x: F.struct(x["bbox"].alias("bbox"), cells.alias("cells"))).alias("tables"))
