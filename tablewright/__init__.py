"""Tabular data preparation as lazy Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers that run in tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
