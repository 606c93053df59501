"""loomspan: event-memory analytics and training-data operators on PySpark.

Every operator is a ``DataFrame -> DataFrame`` function.  Python functions that
run on executors are pickled by value, so a cluster needs no installed copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
