"""Station measurement analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from stationweave.model import Measurements
from stationweave.session import configure

# Ship the few Python task functions by value, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Measurements", "configure"]
