"""Orrery: code facts, retrieval and claim checking as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
