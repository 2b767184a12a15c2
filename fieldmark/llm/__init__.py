"""Operators of a training-data pipeline: cleaning, deduplication, packing and formatting at table scale.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
