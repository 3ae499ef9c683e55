"""Conversation-risk analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
