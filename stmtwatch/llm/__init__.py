"""Preparation of training text: mixing, tokenising, filtering and deduplication of document tables.

The functions that run inside tasks travel with the job, so executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
