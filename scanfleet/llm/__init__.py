"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import scanfleet
from pyspark import cloudpickle

# Python tasks carry the library's functions by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(scanfleet)
