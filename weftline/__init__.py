"""weftline: a Spark-first engine for conversational product search, its offline evaluation, and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
