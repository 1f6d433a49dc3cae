"""Spark-native passage retrieval, retrieval evaluation and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
