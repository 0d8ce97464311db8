"""Operators for large training corpora. Nothing else in the library imports this package.

Functions of this package travel to the Python workers by value, so a cluster needs no installed
copy of it on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
