"""Catalogue, fingerprint and deduplicate large file collections with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
