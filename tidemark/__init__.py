"""tidemark: regime, risk and back-test analytics over large collections of time series, on Spark."""

import sys

from pyspark import cloudpickle

from tidemark.session import checkpoint, get_session

# Functions sent to executors carry the package's code with them, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpoint", "get_session"]
