"""File scans, size guard and image decoding.

Path-table functions take any DataFrame with ``path`` (and ``length``) so
they work on a ``binaryFile`` listing and on a path table alike. The
``binaryFile`` reader prunes ``content`` when it is not selected and pushes
the ``length`` predicate into the listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Params


def suffix(path: Column) -> Column:
    """Lower-cased final suffix of the file name ('' when none)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def list_files(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """Regular files directly in ``folder`` (no recursion)."""
    df = spark.read.format("binaryFile").load(folder)
    cols = ["path", "modificationTime", "length"] + (["content"] if with_content else [])
    return df.select(*cols)


def scan_images(files: DataFrame, params: Params = Params()) -> DataFrame:
    """Image files of a folder, sorted by path."""
    return files.where(suffix(F.col("path")).isin(*params.image_suffixes)).orderBy("path")


def route(path: Column, is_folder: Column) -> Column:
    """Which pipeline a path goes to: a folder is scanned for images, a ``.pdf`` is read
    page by page, any other single file (whatever its suffix) is one image."""
    return F.when(is_folder, "folder").when(suffix(path) == ".pdf", "pdf").otherwise("image")


def scan_batch(files: DataFrame, limit: int | None = None, params: Params = Params()) -> DataFrame:
    """Batch-run selection (its own suffix set); optional limit after the sort."""
    out = files.where(suffix(F.col("path")).isin(*params.batch_suffixes)).orderBy("path")
    return out.limit(limit) if limit is not None else out


def scan_any(files: DataFrame, limit: int | None = None) -> DataFrame:
    """S3: all regular files, sorted, optional limit (cache warming)."""
    out = files.orderBy("path")
    return out.limit(limit) if limit is not None else out


def size_guard(files: DataFrame, params: Params = Params()) -> DataFrame:
    """Mark files over the size cap (strictly greater) as rejected."""
    too_big = F.col("length") > F.lit(params.max_file_bytes)
    return files.withColumns({
        "accepted": ~too_big,
        "reason": F.when(too_big, F.lit("File too large")),
    })


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decode images with Spark's image source; undecodable files are kept
    (dropInvalid=false) and replaced by the 10x10 white placeholder."""
    df = spark.read.format("image").option("dropInvalid", False).load(folder)
    img = F.col("image")
    bad = img["height"] < 0
    placeholder = F.struct(img["origin"].alias("origin"), F.lit(10).alias("height"), F.lit(10).alias("width"),
                           F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
                           F.unhex(F.repeat(F.lit("FF"), 300)).alias("data"))
    return df.select(img["origin"].alias("path"), F.when(bad, placeholder).otherwise(img).alias("image"),
                     bad.alias("placeholder"))


def image_pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """Decoded images -> pixel table ``(key, y, x, c, v)`` (BGR order, row-major)."""
    img = F.col("image")
    # the bytes become one array first: exploding indices would copy the image into every pixel row
    values = F.transform(F.sequence(F.lit(1), F.length(img["data"])), lambda i: F.conv(F.hex(F.substring(img["data"], i, F.lit(1))), 16, 10).cast("int"))
    flat = images.select(key, img["width"].alias("w"), img["nChannels"].alias("n"), F.posexplode(values).alias("i", "v"))
    per_row = F.col("w") * F.col("n")
    return flat.select(key, F.floor(F.col("i") / per_row).cast("int").alias("y"), F.floor((F.col("i") % per_row) / F.col("n")).cast("int").alias("x"),
                       (F.col("i") % F.col("n")).cast("int").alias("c"), "v")
