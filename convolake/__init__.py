"""Convolake: Spark-native analytics over archives of assistant conversations and text corpora."""

import sys

from pyspark import cloudpickle

#: Python workers get the functions themselves, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
