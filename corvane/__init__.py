"""A Spark-native engine for document corpora: retrieval, knowledge graphs and training-data preparation."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
