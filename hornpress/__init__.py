"""Semantic compression of relational data by Horn rules, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that Spark runs in Python are sent whole: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
