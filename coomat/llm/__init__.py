"""Operators of a large-scale training-data pipeline.  Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import coomat.llm as _self

# Functions of this subpackage travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(_self)
