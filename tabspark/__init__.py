"""Tabular profiling, cleaning, feature engineering and model evaluation on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# functions sent to executors travel with their code, so the package need not be installed there
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
