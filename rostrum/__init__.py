"""rostrum: speech and transcript analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The package's Python functions travel to the executors with the code they call, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
