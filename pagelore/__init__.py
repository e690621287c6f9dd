"""Document-structure analytics on Spark: DataFrames in, DataFrames out.

Functions that run in Spark's Python workers are shipped by value, so executors need numpy and pyarrow, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
