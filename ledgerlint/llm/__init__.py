"""Operators for training-data pipelines over web-scale document tables.

Each module holds one operator as a function from DataFrame to DataFrame;
``queries`` registers the thin queries over the driver tables. Task code is
pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
