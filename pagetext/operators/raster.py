"""Raster algebra on pixel tables: R1-R2, F7, W3-W5, A7-A9.

Images are long tables ``(image_id, y, x[, c], v)`` (c: 0=B, 1=G, 2=R).
Per-image statistics are partial aggregations joined back to the pixels
(AQE broadcasts the per-image rows when small), not windows, so a large
image is never sorted in one task.

Float arithmetic follows the 32-bit pixel kernels: weights and stretch
factors are FLOAT, results truncate to 0..255.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Grey weights for B, G, R.
GRAY_WEIGHTS = (0.114, 0.587, 0.299)


def _f32(x) -> F.Column:
    return F.lit(x).cast("float")


def _u8(x: F.Column) -> F.Column:
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(255)).cast("int")


def grayscale(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """(B,G,R) -> 0.114B + 0.587G + 0.299R in float32, clipped, truncated."""
    wide = pixels.groupBy(image, "y", "x").agg(
        *[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"c{i}") for i in range(3)])
    acc = _f32(0.0)
    for i, w in enumerate(GRAY_WEIGHTS):
        acc = acc + F.col(f"c{i}").cast("float") * _f32(w)
    return wide.select(image, "y", "x", _u8(acc).alias("v"))


def invert(pixels: DataFrame) -> DataFrame:
    """R2: 255 - v."""
    return pixels.withColumn("v", (F.lit(255) - F.col("v")).cast("int"))


def bgr_channels(pixels: DataFrame, channels: DataFrame, image: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """make every image 3-channel BGR. 1 channel -> replicated, 4 -> alpha
    dropped, 3 -> kept; any other count goes to the reject table."""
    j = pixels.join(channels.select(image, "channels"), image)
    ok = F.col("channels").isin(1, 3, 4)
    gray = (j.where(F.col("channels") == 1)
            .select(image, "y", "x", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("c"), "v"))
    colour = j.where(F.col("channels").isin(3, 4) & (F.col("c") < 3)).select(image, "y", "x", "c", "v")
    rejects = (j.where(~ok).select(image, "channels").distinct()
               .withColumn("reason", F.concat(F.lit("Unsupported channel count: "), F.col("channels").cast("string"))))
    return gray.unionByName(colour), rejects


def contrast_stretch(gray: DataFrame, image: str = "image_id") -> DataFrame:
    """Per-image min/max stretch to 0..255 (unchanged when the range < 1e-3)."""
    st = gray.groupBy(image).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = gray.join(st, image)
    rng = (F.col("hi") - F.col("lo")).cast("double")
    norm = (F.col("v") - F.col("lo")).cast("double") / rng
    out = F.when(rng < 1e-3, F.col("v")).otherwise(_u8(norm * 255.0))
    return j.select(image, "y", "x", out.cast("int").alias("v"))


def mean_threshold(gray: DataFrame, image: str = "image_id") -> DataFrame:
    """255 where the pixel is above the image mean, else 0."""
    st = gray.groupBy(image).agg(F.avg("v").alias("mean_v"))
    return gray.join(st, image).select(image, "y", "x",
                                       F.when(F.col("v") > F.col("mean_v"), 255).otherwise(0).alias("v"))


def raster_stats(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Height, width and mean value per image."""
    return pixels.groupBy(image).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"),
                                     F.avg("v").alias("mean_v"))


def _line_sums(gray: DataFrame, image: str, axis: str) -> DataFrame:
    return gray.groupBy(image, axis).agg(F.sum("v").cast("long").alias("s"))


def _var_parts(sums: DataFrame, image: str) -> DataFrame:
    return sums.groupBy(image).agg(F.count(F.lit(1)).alias("n"), F.sum("s").cast("decimal(38,0)").alias("sx"),
                                   F.sum(F.col("s").cast("decimal(38,0)") * F.col("s")).alias("sxx"))


def projection_score(gray: DataFrame, image: str = "image_id") -> DataFrame:
    """Population variance of the row sums, with its exact integer form
    ``n * sum(x^2) - sum(x)^2`` (= variance * n^2)."""
    p = _var_parts(_line_sums(gray, image, "y"), image)
    exact = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("decimal(38,0)")
    return p.select(image, F.col("n").alias("rows"), exact.alias("score_n2"),
                    (exact.cast("double") / (F.col("n") * F.col("n"))).alias("score"))


def best_rotation(gray: DataFrame, image: str = "image_id") -> DataFrame:
    """Of 0/90/180/270 degrees the first with the highest projection score.

    Rotating by 180 keeps the row sums (reversed), 90 and 270 turn columns into
    rows, so the choice is between 0 (rows) and 90 (columns); ties keep 0. The
    comparison uses the exact integer forms.
    """
    lines = gray.select(image, "v", F.inline(F.array(F.struct(F.lit("y").alias("axis"), F.col("y").alias("i")),
                                                      F.struct(F.lit("x").alias("axis"), F.col("x").alias("i")))))
    sums = lines.groupBy(image, "axis", "i").agg(F.sum("v").cast("decimal(18,0)").alias("s"))
    big = "decimal(38,0)"

    def pick(axis: str, value) -> F.Column:
        return F.when(F.col("axis") == axis, value)
    s = F.col("s").cast(big)
    j = sums.groupBy(image).agg(*[agg for a in ("y", "x") for agg in (
        F.count(pick(a, F.lit(1))).alias(f"n_{a}"), F.sum(pick(a, s)).cast(big).alias(f"sx_{a}"), F.sum(pick(a, s * s)).cast(big).alias(f"sxx_{a}"))])

    def spread(a: str) -> F.Column:     # n^2 times the variance, exact
        return (F.col(f"n_{a}").cast(big) * F.col(f"sxx_{a}") - F.col(f"sx_{a}") * F.col(f"sx_{a}")).cast(big)
    ny, nx = F.col("n_y").cast("decimal(9,0)"), F.col("n_x").cast("decimal(9,0)")
    # var_rows >= var_cols  <=>  spread_y * n_x^2 >= spread_x * n_y^2
    upright = (spread("y") * (nx * nx).cast("decimal(18,0)")).cast(big) >= (spread("x") * (ny * ny).cast("decimal(18,0)")).cast(big)
    return j.select(image, F.when(upright, 0).otherwise(90).alias("angle"),
                    (spread("y").cast("double") / (F.col("n_y") * F.col("n_y"))).alias("row_score"),
                    (spread("x").cast("double") / (F.col("n_x") * F.col("n_x"))).alias("col_score"))


def skew_angle(lines: DataFrame, image: str = "image_id", max_lines: int = 20) -> DataFrame:
    """Median deskew angle from the first ``max_lines`` detected lines
    (``rank``, ``theta`` radians); near-horizontal normals are ignored; no
    usable line -> 0.0; ``rotate`` is false when |angle| < 0.1."""
    deg = F.col("theta") * F.lit(180.0 / math.pi)
    usable = lines.where(F.col("rank") < max_lines).select(image, deg.alias("a"))
    usable = usable.where(~(((F.col("a") > 80) & (F.col("a") < 100)) | ((F.col("a") > 260) & (F.col("a") < 280))))
    med = usable.groupBy(image).agg(F.percentile(F.col("a") - 90, 0.5).alias("angle"))
    images = lines.select(image).distinct()
    out = images.join(med, image, "left").select(image, F.coalesce(F.col("angle"), F.lit(0.0)).alias("angle"))
    return out.withColumn("rotate", F.abs(F.col("angle")) >= 0.1)
