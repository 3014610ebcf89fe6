"""Event-log analytics as Spark DataFrame functions.

Every operator takes DataFrames and parameters and returns a DataFrame. The
wall clock is never read inside an operator; callers pass ``as_of``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
