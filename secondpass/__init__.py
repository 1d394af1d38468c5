"""Budgeted second-pass processing of table records, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors with their helpers, so the package does
# not have to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
