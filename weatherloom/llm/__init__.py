"""Operators for preparing training text. Nothing outside this package imports it.

Functions that run in tasks travel with the job by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
