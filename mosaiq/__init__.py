"""A Spark-native engine for labelled-region image data."""

import sys

from pyspark import cloudpickle

# kernels travel with their tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
