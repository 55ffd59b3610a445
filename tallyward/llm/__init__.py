"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage. Task functions are shipped to executors by value,
so that executors need pyarrow and numpy but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
