"""A Spark-native engine for turning long-form text into training data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Workers may lack this package on their path: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
