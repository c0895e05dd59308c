"""Session recommendation analytics on Spark DataFrames.

``sources``    tables in, tables out
``functions``  column expressions
``operators``  DataFrame -> DataFrame building blocks
``plans``      multi-step jobs made of operators
"""

import sys

from pyspark import cloudpickle

# Arrow kernels travel to Python workers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
