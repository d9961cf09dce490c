import datetime as dt
import os
import time

from pyspark.sql import functions as F

from pagetext.sources.readers import line_numbers
from pagetext.streaming.metrics import read_windows, stream_windows, windowed_metrics

SCHEMA = "ts timestamp, event_type string, value double"
START = dt.datetime(2024, 1, 1)


def minute(m, kind="a", value=100.0):
    return (START + dt.timedelta(minutes=m), kind, value)


def test_late_rows_are_dropped_and_state_is_bounded(spark, tmp_path):
    files = [[minute(3 * f + i, kind) for i in range(3) for kind in "ab"] for f in range(40)]
    late = [minute(1, "a"), minute(2, "b"), minute(2, "b")]
    files.append(late + [minute(125)])
    folder = tmp_path / "events"
    for n, rows in enumerate(files):          # files are read in the order of their times
        part = str(tmp_path / f"part{n}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(part)
        os.makedirs(folder, exist_ok=True)
        name = next(x for x in os.listdir(part) if x.endswith(".parquet"))
        os.replace(f"{part}/{name}", f"{folder}/f{n:03}.parquet")
        stamp = time.time() - 1000 + 2 * n
        os.utime(f"{folder}/f{n:03}.parquet", (stamp, stamp))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    progress = stream_windows(spark, str(folder), SCHEMA, out, checkpoint, files_per_trigger=1)
    on_time = [r for rows in files for r in rows if r not in late] + [r for r in files[0] if r in late]
    want = windowed_metrics(spark.createDataFrame(on_time, "ts timestamp, endpoint string, seconds double").withColumn("seconds", F.col("seconds") / 100))
    closed = {tuple(r) for r in want.where("window.end <= timestamp'2024-01-01 01:55:00'").collect()}
    got = read_windows(spark, out).collect()
    assert {tuple(r) for r in got} == closed and len(got) == len(closed)
    assert sum(p["late_groups"] for p in progress) == 2
    assert max(p["state_rows"] for p in progress) <= 14
    again = stream_windows(spark, str(folder), SCHEMA, out, checkpoint, files_per_trigger=1)
    assert read_windows(spark, out).count() == len(closed) and not any(p["late_groups"] for p in again)


def test_line_numbers_of_many_splits(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(5000).repartition(4, "id").select(F.col("id").cast("string").alias("value")).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        numbered = line_numbers(spark.read.text(path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = sorted(map(tuple, numbered.collect()))
    names = sorted(x for x in os.listdir(path) if x.endswith(".txt"))
    plain = [line for n in names for line in open(f"{path}/{n}").read().splitlines()]
    assert got == list(enumerate(plain))
