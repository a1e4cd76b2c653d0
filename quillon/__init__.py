"""Full-text search and analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
