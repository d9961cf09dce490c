"""pagetext: recognised-document text processing on Spark."""

import sys as _sys

# UDFs defined in this package are pickled by value, so executors need no
# installed copy of the package (nothing to ship or install per cluster).
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark
    pass
