"""Run catalogs, job logs, files, matrices and sequences on Spark."""

import sys

from pyspark import cloudpickle

# Python workers receive this package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
