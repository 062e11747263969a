"""Training-data operators: one module each, and the queries that apply them to whole tables.

Functions that run in Python workers travel by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
