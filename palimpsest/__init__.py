"""Web-archive analytics on Spark DataFrames.

Functions that run on executors travel there by value, so executors need no
installation of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
