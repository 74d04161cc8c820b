"""Threadloom: session-log analytics and text-corpus operators as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions and data sources that run inside tasks travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
