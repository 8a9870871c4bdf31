"""rollstat: post-training data and evaluation analytics as PySpark DataFrame jobs."""
import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
