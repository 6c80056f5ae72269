"""Operators for preparing training data at corpus scale.

The package is self-contained: nothing else in the library imports it.  Its
functions travel to executors by value, so executors need no installation.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
