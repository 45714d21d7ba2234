"""Operators of a training-data pipeline; nothing else in the package imports this one.

Functions of this subpackage that run in Python workers are sent there by value, so that executors
need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
