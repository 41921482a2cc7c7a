"""Detection analytics over web access logs, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
