"""loomline: conversation and document analytics on Spark.

Functions that run inside Spark tasks are shipped by value, so executors need
Python, pyarrow and numpy but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
