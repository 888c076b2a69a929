"""paperloom: DataFrame operators for analysing text corpora on Spark."""

import sys

from pyspark import cloudpickle

# Python workers of a cluster need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
