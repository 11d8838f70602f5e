"""Operators for training-data pipelines. Nothing outside this subpackage imports it.

What runs inside tasks travels with the job, so that executors need the libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
