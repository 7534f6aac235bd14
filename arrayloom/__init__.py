"""arrayloom: analytics of dense sensor-array recordings as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame. Operators that iterate or that write an intermediate
table run jobs while they are called; their docstrings or modules say so. The others run nothing until the caller acts.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
