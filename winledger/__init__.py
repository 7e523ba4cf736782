"""Workload analytics for model-call logs, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Column helpers that run in Python workers travel by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
