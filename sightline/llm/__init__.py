"""Operators for preparing text at scale: deduplication, decontamination, quality, privacy, extraction, encoding.

Every module holds one operator with its own interface; ``queries`` holds the thin registered queries.  Functions that
run inside tasks travel with the task, so the workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
