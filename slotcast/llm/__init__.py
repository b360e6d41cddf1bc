"""Operators that prepare text for training language models.

Functions of this package travel to the workers with their jobs, so executors
need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
