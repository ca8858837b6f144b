"""URL and page risk analytics as Spark DataFrame, Spark ML and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Python workers need not find the package on their path: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
