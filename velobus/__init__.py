"""velobus: batch and streaming analytics for city bike and bus data on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
