"""Document search analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from linetrawl.spec import ScanSpec, SearchSpec

# Functions that run in Python workers travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ScanSpec", "SearchSpec"]
