"""Quernstone: a Spark-native engine for curating, auditing and measuring text datasets."""

import sys

from pyspark import cloudpickle

# Arrow functions travel with their tasks, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
