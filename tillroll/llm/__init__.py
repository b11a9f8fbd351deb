"""Operators for training-data corpora; nothing else in the library imports this package.

Functions of this package that run inside Python workers are shipped by value, so executors
need the third-party libraries but no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
