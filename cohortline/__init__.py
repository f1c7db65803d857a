"""Cohort and time-series analytics over timed measurements, as plain Spark DataFrame code."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so no worker has to be able to import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
