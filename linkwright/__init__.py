"""linkwright: a Spark-native record-linkage analytics engine.

The package is pickled by value, so executors need Spark and the third-party
libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
