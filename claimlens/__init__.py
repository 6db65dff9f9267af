"""Spark-native analytics over claims, audit events, detector scores and document text."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions with the job, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
