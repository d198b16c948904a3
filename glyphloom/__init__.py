"""Spark-native corpus and n-gram language-model analytics."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
