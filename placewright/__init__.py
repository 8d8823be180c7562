"""placewright: place-data analytics as lazy DataFrame and SQL plans.

Functions that run in Python workers are shipped by value, so executors need
Spark, numpy, pandas and pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
