"""Operators that prepare text corpora for training language models.

Nothing else in the package imports this folder. Every operator takes a DataFrame and the names of the columns it works
on, treats other columns as payload, and returns a DataFrame. The registered queries are in ``queries``.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with the code they call, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
