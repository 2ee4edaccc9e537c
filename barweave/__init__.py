"""barweave: market-bar analytics and training-data operators on PySpark."""

import os
import sys

# Functions that run inside Python workers are sent by value when the workers could not import this
# package by its path (a driver that only extended sys.path, for example).
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
