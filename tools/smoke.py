"""Run every registered query at a scale factor and report rows / time / errors."""
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
from pagetext.session import build_session  # noqa: E402
from pagetext.plans.catalog import QUERIES  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
only = sys.argv[2].split(",") if len(sys.argv) > 2 else None
spark = build_session()
for name, fn in QUERIES.items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        n = df.count()
        print(f"OK   {name:26s} rows={n:<8d} {time.time() - t:6.2f}s {df.columns}", flush=True)
    except Exception as exc:  # report and continue
        msg = str(exc).strip().splitlines()
        print(f"FAIL {name:26s} {type(exc).__name__}: {msg[0][:300] if msg else ''}", flush=True)
        if only:
            traceback.print_exc()
