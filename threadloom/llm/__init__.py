"""Training-data operators: quality, packing, search, deduplication, scans, tokens and chat formatting.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
