"""Operators for building training corpora from tables of documents.

Nothing outside this subpackage imports it.  Its functions are shipped to
executors by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
