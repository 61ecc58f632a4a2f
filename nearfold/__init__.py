"""nearfold: nearest-neighbour search and vector data processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors inside the jobs, so they need no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
