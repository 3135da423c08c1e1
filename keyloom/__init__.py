"""Keyed-table analytics on PySpark: a small SQL dialect, last-write-wins storage and
large-scale table maintenance operators, all expressed as DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that run on executors travel with the job, so workers need no copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
