"""Operators for large-scale training-data pipelines; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Worker functions travel by value, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
