"""Operations of a training-data pipeline. Nothing outside this subpackage imports it.

Functions that run in Python workers travel by value, so executors need the installed libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
