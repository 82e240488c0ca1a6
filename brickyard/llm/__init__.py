"""Operators for preparing training text: secrets, toxicity, duplicates, counts, archives."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job; they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
