"""lodestar: a Spark-first analytics engine for aligned reads, vectors, merge plans and graphs."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
