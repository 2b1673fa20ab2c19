"""Spark-native analytics for caption and video-moment data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
