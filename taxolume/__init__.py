"""Spark-native concept search, ranking and ontology analytics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
