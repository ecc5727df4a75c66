"""Survey, grid and trajectory analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
