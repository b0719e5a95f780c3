"""Retrieval and evaluation operators on Spark.

Functions of this package that run in Python workers are pickled by value, so a
cluster's workers need no copy of it and no search path for it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
