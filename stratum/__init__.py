"""Snapshot analytics and corpus preparation, declared as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
