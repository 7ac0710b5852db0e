"""Lecture analytics and training-data preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
