"""docfields: structured-document extraction, evaluation and profiling as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
