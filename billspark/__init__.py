"""Utility-bill analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors inside the job itself, so a cluster
# needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
