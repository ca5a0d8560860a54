"""Loomworks: a PySpark-native analytics engine for operational and text data."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
