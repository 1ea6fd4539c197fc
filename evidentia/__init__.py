"""Evidence-consistency analytics on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Worker functions travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
