"""Dredgeline: data mining and analytics operators on PySpark DataFrames.

Every operator takes DataFrames and returns DataFrames; Catalyst and AQE choose the physical strategy.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to Python workers by value, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
