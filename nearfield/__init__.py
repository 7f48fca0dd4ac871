"""Filtered nearest-neighbour analytics on Spark: exact and approximate top-k over vector tables."""

import sys

from pyspark import cloudpickle

#: Python stages carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
