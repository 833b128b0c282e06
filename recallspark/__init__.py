"""Conversation corpus preparation and retrieval as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from recallspark.settings import Settings

# Functions that run in Python workers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
