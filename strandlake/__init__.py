"""Spark-native genomic interval analytics.

Functions of this package that run on executors are shipped by value, so that
a cluster needs no copy of the package on its worker machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
