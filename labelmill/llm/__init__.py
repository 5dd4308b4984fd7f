"""Operators for preparing training text: archives, search, deduplication, decontamination, tokens and shards.

Nothing outside this folder imports it. Functions that run on workers travel by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
