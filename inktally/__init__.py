"""Embedding-cost analytics on Spark: table rows to documents, tokens and prices."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so that the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
