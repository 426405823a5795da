"""Dataset mixing, retrieval, preference and reward tables as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in tasks travel with the job, so workers need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
