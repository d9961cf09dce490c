"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pagetext.plans.catalog import QUERIES  # noqa: E402
from pagetext.session import SPREAD_CONF, build_session  # noqa: E402

HEADLINE = ("response_struct", "number_lines", "normalize_text", "language_heuristic", "cer", "wer",
            "latency_report", "request_metrics", "cache_get_or_set", "spell_correct", "first_success",
            "table_summary", "best_rotation")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8))
    spark.conf.set(SPREAD_CONF, str(cpus * 2))   # the test tables are single row groups
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        # consume every column on the executors (a plain count() would let the
        # optimizer prune computed columns); only one row reaches the driver
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns) % 1000003).alias("h")).collect()[0]
        rows[name] = int(r["n"])
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "rows": rows, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
