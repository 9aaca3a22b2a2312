"""Spark-native analytics for labelled, multi-channel signal segments grouped by subject."""

import sys

from pyspark import cloudpickle

# Python kernels travel to the executors by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
