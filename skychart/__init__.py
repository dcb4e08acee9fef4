"""Turns a table of described items and a log of their usage into a searchable 2-D map, on Spark."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
