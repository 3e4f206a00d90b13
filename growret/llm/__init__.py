"""Training-data operators.  Nothing else in the library imports this package.

Its functions travel to the executors by value, so Python workers need numpy
and pyarrow but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
