"""Spark-native retrieval analytics: text analysis, postings, sparse/dense/hybrid search and ranking metrics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
