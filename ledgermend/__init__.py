"""Spark-native reconciliation of multi-source financial records.

Every operator is a plain function over ``Column`` or ``DataFrame``; Catalyst
plans the work.  Functions that run in Python workers are shipped by value, so
executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
