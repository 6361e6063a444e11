"""voxtide: Spark-first analytics for large collections of free-text feedback."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the job, so that executors need
# nothing but PySpark, numpy and pandas installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
