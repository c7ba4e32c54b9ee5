"""Tideglass: a Spark-first engine for attack-behaviour analytics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so workers need not have this package on their path. What is broadcast
# is pickled otherwise and must therefore be made of plain values.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
