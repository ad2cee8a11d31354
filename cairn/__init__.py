"""Cairn: analytics over source-code history and structure, as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions of it travel with the task that calls them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
