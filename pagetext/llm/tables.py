"""Reading the input tables, stored intermediate tables, column names that cannot clash."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_table_path

# A side is broadcast only when a count of its rows stays within this bound.
BROADCAST_ROWS = 50_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows of one key that are numbered in one sort, about.
NUMBERED_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: cuts the
    lineage, survives lost executors, and fixes what was computed once."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffle_files_removed(spark: SparkSession):
    """Shuffle files of a finished write go at once, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, otherwise
    as it is (the join then shuffles). Counting is a job: pass a stored table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose name (any case) an operator is about to add."""
    out = {n.lower() for n in names}
    return df.select(*[df[quoted(c)] for c in df.columns if c.lower() not in out])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row; orders rows whose key is equal (map columns,
    which have no hash, are left out)."""
    def hashable(t: T.DataType) -> bool:
        return "map<" not in t.simpleString() and "variant" not in t.simpleString()
    return F.xxhash64(*[F.col(quoted(f.name)) for f in df.schema.fields if hashable(f.dataType)])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def numbered_repeats(df: DataFrame, repeats: DataFrame, key: list[str], number: str) -> DataFrame:
    """``df`` with ``number``: the place (from 0) of a row among those of its key where the key
    is in ``repeats`` (a stored table of the key columns and ``n``, how many rows have it), else 0.

    Which of a key's rows gets which number is left open, so call it for rows that are equal
    in what matters. Rows of repeated keys are stored first, so that every job sees the same
    numbers; a key of many rows is numbered in chunks, whose offsets are running sums."""
    if not repeats.limit(1).count():
        return df.withColumn(number, F.lit(0).cast("long"))
    of_key, times, place, chunk, first = (unused(df, n) for n in ("of_key", "times", "place", "chunk", "first"))
    hot = repeats.select(F.struct(*[F.col(quoted(c)) for c in key]).alias(of_key), F.col("n").alias(times))
    hot = small_side(stored(hot, "repeated-keys"))
    here = F.struct(*[F.col(quoted(c)) for c in key])
    once = df.join(hot, here.eqNullSafe(F.col(of_key)), "left_anti").withColumn(number, F.lit(0).cast("long"))
    again = df.join(hot, here.eqNullSafe(F.col(of_key))).withColumn(place, F.monotonically_increasing_id())
    chunks = F.ceil(F.col(times) / F.lit(NUMBERED_ROWS)).cast("long")
    again = stored(again.withColumn(chunk, F.pmod(F.xxhash64(place), chunks)), "repeated-rows")
    sizes = again.groupBy(of_key, chunk).agg(F.count(F.lit(1)).alias(times))
    before = Window.partitionBy(of_key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sizes = small_side(stored(sizes.select(F.col(of_key).alias("k"), F.col(chunk).alias("c"), F.coalesce(F.sum(times).over(before), F.lit(0)).alias(first)),
                              "repeated-chunks"))
    row = F.row_number().over(Window.partitionBy(of_key, chunk).orderBy(place))
    again = again.withColumn(number, row - 1).join(sizes, F.col(of_key).eqNullSafe(F.col("k")) & (F.col(chunk) == F.col("c")))
    again = again.withColumn(number, (F.col(number) + F.col(first)).cast("long"))
    return once.unionByName(again.select(*[F.col(quoted(c)) for c in df.columns], number))
