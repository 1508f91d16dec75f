"""Operators of a training-data pipeline: duplicates, quality, mixing, tokens, scores."""

import sys

from pyspark import cloudpickle

# Tasks get these modules with their functions: executors need not have them installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
