"""Spark-native certification of oriented detections, plus a text-corpus subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
