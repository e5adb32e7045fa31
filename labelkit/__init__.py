"""Spark jobs for sequence labelling."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel whole, so workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
