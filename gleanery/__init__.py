"""Spark-native engine for building, scoring and searching a web-page corpus."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
