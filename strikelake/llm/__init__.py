"""Operators for training-data pipelines over document tables. Nothing else imports this package.

Its functions are sent to the Python workers by value, so that executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
