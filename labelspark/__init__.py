"""Text-classification data preparation and evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: no copy of it is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
