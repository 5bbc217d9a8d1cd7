"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Its functions travel to
the Python workers by value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
