"""Training-data operators: classify, scan, shard, de-duplicate, tokenize, count, mix, search, prove, audit.

Nothing else in the library imports this package.  The functions that run inside
Python tasks are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
