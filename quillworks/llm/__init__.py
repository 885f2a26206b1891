"""Operators for preparing training text at scale; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package by value: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
