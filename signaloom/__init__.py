"""Spark-native analytics for multichannel recordings and for text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
