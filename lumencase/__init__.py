"""lumencase: a PySpark-native analytics engine for large catalogs of media files."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of this package: functions shipped to Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
