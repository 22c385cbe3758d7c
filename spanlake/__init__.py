"""spanlake: DataFrame operators for text-span, vector and cluster analytics on Spark."""

import sys

from pyspark import cloudpickle

from spanlake.session import checkpoint_dir, get_session

# Functions of this package travel to the executors inside the job, so they need no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpoint_dir", "get_session"]
