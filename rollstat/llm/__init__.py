"""Operators for preparing large text corpora.

Nothing else in the library imports this package.
"""
import sys

from pyspark import cloudpickle

# Kernels travel with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
