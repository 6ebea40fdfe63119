"""Catalogue and text analytics on Spark DataFrames.

The package is sent to executors by value, so a cluster needs no install of it.
"""

import sys

try:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, ValueError):  # pragma: no cover - very old or foreign pickler
    pass
