"""Operators for preparing training text: duplicates, archives, secrets, filters, mixing, shards."""

import sys

from pyspark import cloudpickle

# Tasks carry these modules' functions with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
