"""Operators for preparing training text at corpus scale, and their queries.

Nothing else in the library imports this subpackage.  Functions that run
inside Spark tasks are shipped to the executors by value, so a cluster needs
no copy of this package on its nodes (only numpy, pyarrow and xxhash).
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
