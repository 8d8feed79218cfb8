"""weftgraph: property-graph analytics and corpus processing on PySpark.

The package is registered for by-value pickling, so Python workers run its
functions even on executors where it is not installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
