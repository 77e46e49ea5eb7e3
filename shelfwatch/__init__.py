"""Catalogue change analytics on PySpark.

The few functions that run in Python workers travel with the query that uses them, so executors
need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
