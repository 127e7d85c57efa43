"""Operators for preparing language-model training data; nothing else in the library imports them.

Functions of this package that run in tasks travel with the tasks, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
