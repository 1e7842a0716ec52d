"""Operations for training-data pipelines.  Nothing else in the library imports this package.

Functions that run in Python workers travel with their tasks, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
