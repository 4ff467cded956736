"""Operators for training data: filters, deduplication, scoring, search and packing."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
