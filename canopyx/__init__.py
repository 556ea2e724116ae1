"""Spatial annotation analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: no installation or path is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
