"""Lead processing and licence analytics as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Python steps travel to the executors by value, so those need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
