"""starloom: sky-survey catalogue analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors may lack this package on their path, so functions sent to them carry its code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
