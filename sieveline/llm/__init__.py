"""Operators for preparing training data. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# what runs in tasks travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
