"""A Spark-native engine for sequence sketches, similarity graphs and the comparison of clusterings."""

import sys

from pyspark import cloudpickle

__all__ = ["__version__"]
__version__ = "0.1.0"

# Executors need no copy of this package: functions that Spark ships to its Python workers carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
