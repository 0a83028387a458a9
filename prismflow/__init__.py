"""prismflow: Spark-first analytics over labelled one-dimensional patterns and feature vectors.

Functions of this package that run inside Python workers are pickled by value, so executors
need no copy of the package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
