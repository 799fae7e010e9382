"""Weak-signal analytics over dated, multi-source documents, as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
