"""Event detection and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks that call them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
