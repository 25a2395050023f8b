"""Training-data operators.  Nothing else in the package imports this subpackage.

Functions that run on executors are pickled by value, so a worker needs the
third-party libraries only and no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
