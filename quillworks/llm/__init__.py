"""Corpus operators for language-model training data.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Workers may lack this package on their path: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
