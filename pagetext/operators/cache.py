"""The result cache as a table.

The cache is a Parquet table ``(key, text, language, engine_name, created_at)``
with one row per key, keyed by the SHA-256 of the input content. Lookups are
joins, replacement keeps the newest row of a key, and every write goes to a new
version folder under the shared checkpoint folder (never over the path being
read). ``VersionedTable`` names the current one.

Aggregations carry fixed-width values only (a row's stamp, the smallest id), so
they run as hash aggregations with partial sums and a key held by very many
rows is not gathered; texts are joined last, by the row that won.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DUMMY_TEXT
from ..session import new_table_path
from .guard import required


def content_key(content: Column) -> Column:
    """H1: SHA-256 hex of the bytes (strings hash their UTF-8 bytes)."""
    return F.sha2(content, 256)


def is_dummy(engine_name: Column, text: Column) -> Column:
    return F.coalesce(engine_name == "dummy", F.lit(False)) | F.coalesce(text == DUMMY_TEXT, F.lit(False))


def latest_per_key(cache: DataFrame, key: str = "key", ts: str = "created_at") -> DataFrame:
    """One row per key: the newest, of equally new ones that with the largest row
    hash (the same whatever the order of the rows)."""
    others = [c for c in cache.columns if c != key]
    # newest first (no time is oldest), then the hash: one number of fixed width
    stamp = (F.coalesce(F.unix_micros(F.col(ts)).cast("decimal(17,0)"), F.lit("-" + "9" * 17).cast("decimal(17,0)")) * F.lit(str(1 << 64)).cast("decimal(20,0)")
             + F.xxhash64(*others).cast("decimal(20,0)")).cast("decimal(38,0)")
    rows = cache.withColumn("stamp", stamp)
    best = rows.groupBy(F.col(key).alias("best_key")).agg(F.max("stamp").alias("best"))
    won = rows.join(best, F.col(key).eqNullSafe(F.col("best_key")) & F.col("stamp").eqNullSafe(F.col("best")))
    # what is left twice are equal rows, already together by key
    return won.dropDuplicates([key, "stamp"]).select(*cache.columns)


def evict_dummy(cache: DataFrame) -> DataFrame:
    """C4: results of the dummy engine are misses; they are removed."""
    return cache.where(~is_dummy(F.col("engine_name"), F.col("text")))


def valid_cache(cache: DataFrame) -> DataFrame:
    return latest_per_key(evict_dummy(cache))


def least_per_key(inputs: DataFrame, key: str = "key", order: str = "doc_id") -> DataFrame:
    return inputs.groupBy(F.col(key).alias("least_key")).agg(F.min(order).alias("least"))


def dedupe_content(inputs: DataFrame, key: str = "key", order: str = "doc_id", least: DataFrame | None = None) -> DataFrame:
    """One row per distinct content key (processed once, fanned out later): the
    row with the smallest ``order`` value, which names a row. ``least``: only of these keys."""
    least = least if least is not None else least_per_key(inputs, key, order)
    return inputs.join(least, (F.col(key) == F.col("least_key")) & (F.col(order) == F.col("least")), "left_semi")


def cache_hits(inputs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Inputs whose key has a stored (non-dummy) result reuse it."""
    c = valid_cache(cache)
    hits = inputs.join(c.select(key, F.col("text").alias("cached_text"),
                                F.col("language").alias("cached_language"), "engine_name"), key, "inner")
    return hits.withColumn("cached_language", F.coalesce(F.col("cached_language"), F.lit("mix")))


def cache_misses(inputs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Inputs without a usable stored result (none, or a dummy placeholder)."""
    return inputs.join(evict_dummy(cache).select(key), key, "left_anti")


def replace_by_key(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """O3: the rows of ``new`` replace those of ``old`` with the same key; both have
    one row per key, so has the result."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def cache_upsert(cache: DataFrame, new_rows: DataFrame, key: str = "key", ts: str = "created_at") -> DataFrame:
    """Replace by key; the newest ``created_at`` wins. Dummy results are never stored."""
    both = cache.unionByName(new_rows, allowMissingColumns=True)
    return latest_per_key(evict_dummy(both), key, ts)


def get_or_set(inputs: DataFrame, cache: DataFrame, compute, key: str = "key", order: str = "doc_id",
               now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits reuse the stored result; misses are computed once per distinct key by
    ``compute(DataFrame) -> DataFrame[key, text, language, engine_name, error]`` and
    fanned back out to every input row with that key.

    Returns ``(results, new_cache)``. A failed computation has ``error`` set; it is a
    result row (the caller keeps going or aborts, C5/C6) and is not stored. One join
    of (key, id) with the valid cache serves hits and misses.
    """
    now = now if now is not None else F.current_timestamp()
    spark = inputs.sparkSession
    valid = spark.read.parquet(write_version(valid_cache(cache), "valid-cache"))
    known = valid.select(F.col(key).alias("known_key"), F.col("text").alias("known_text"), F.col("language").alias("known_language"),
                         F.col("engine_name").alias("known_engine"))
    looked = inputs.select(key, order).join(known, F.col(key) == F.col("known_key"), "left")
    missing = looked.where("known_key is null").groupBy(key).agg(F.min(order).alias(order))
    todo = inputs.join(missing.select(F.col(key).alias("todo_key"), F.col(order).alias("todo_id")),
                       (F.col(key) == F.col("todo_key")) & (F.col(order) == F.col("todo_id")), "left_semi")
    done = spark.read.parquet(write_version(compute(todo).select(key, "text", "language", "engine_name", "error"), "computed"))
    made = done.select(F.col(key).alias("made_key"), F.col("text").alias("made_text"), F.col("language").alias("made_language"),
                       F.col("engine_name").alias("made_engine"), "error")
    hit = F.col("known_key").isNotNull()
    results = looked.join(made, F.col(key) == F.col("made_key"), "left").select(
        order, key, F.when(hit, F.col("known_text")).otherwise(F.col("made_text")).alias("result_text"),
        F.when(hit, F.coalesce("known_language", F.lit("mix"))).otherwise(F.col("made_language")).alias("result_language"),
        F.coalesce("known_engine", "made_engine").alias("engine_name"), hit.alias("from_cache"), "error")
    columns = [c for c in (key, "text", "language", "engine_name", "created_at") if c in valid.columns]
    stored = done.where("error is null").withColumn("created_at", now)
    return results, replace_by_key(valid.select(*columns), evict_dummy(stored).select(*columns), key)


def warm_cache(results: DataFrame, key: str = "key") -> DataFrame:
    """Keep going: (key, status, error) per distinct input, failures as rows."""
    return results.groupBy(key).agg(F.max("error").alias("error")).select(
        key, F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error")


def process_batch(results: DataFrame, order: str = "doc_id", key: str = "key") -> DataFrame:
    """All or nothing: a failed row aborts the job, whatever is read of the result. Ordered by id."""
    whole = required(results, F.col("error").isNull(), F.concat(F.lit("batch item failed: "), F.col("error")))
    return whole.orderBy(key, order)


def write_version(df: DataFrame, name: str = "cache") -> str:
    """Write a table version to a fresh folder under the shared folder."""
    path = new_table_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return path


class StaleWrite(RuntimeError):
    """Another writer has replaced the version this one started from."""


class VersionedTable:
    """A table that is replaced as a whole (C3): immutable version folders and a
    numbered manifest for each that became current. The highest number names the
    current version. A manifest appears by a rename that fails if its name is taken,
    so of two writers who start from one version the later gets ``StaleWrite``, and a
    reader sees the old version or the new one whole. Superseded folders stay for
    readers that hold them."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.files = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def current(self) -> int:
        """Number of the current version; 0 before the first."""
        manifests = self.path("manifests")
        if not self.files.exists(manifests):
            return 0
        names = [s.getPath().getName() for s in self.files.listStatus(manifests)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the current one)."""
        version = self.current() if version is None else version
        if not version:
            raise FileNotFoundError(f"no version of {self.folder} yet")
        data = self.spark.read.text(f"{self.folder}/manifests/{version:012d}").first()[0]
        return self.spark.read.parquet(f"{self.folder}/{data}")

    def replace(self, rows: DataFrame, started_from: int) -> int:
        """Write ``rows`` as the version after ``started_from``; its number."""
        data = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        if self.current() != started_from:
            raise StaleWrite(f"{self.folder} is no longer at version {started_from}")
        self.files.mkdirs(self.path("manifests"))
        draft = self.path(f"draft-{data}")
        out = self.files.create(draft, False)
        out.write(bytearray(data.encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            draft.toUri() if draft.toUri().getScheme() else self.files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(self.path(f"manifests/{started_from + 1:012d}")), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise StaleWrite(f"{self.folder} is no longer at version {started_from}") from None
            raise
        return started_from + 1

    def upsert(self, new_rows: DataFrame, key: str = "key", ts: str = "created_at") -> int:
        """C3 on the current version."""
        version = self.current()
        rows = cache_upsert(self.read(version), new_rows, key, ts) if version else latest_per_key(evict_dummy(new_rows), key, ts)
        return self.replace(rows, version)
