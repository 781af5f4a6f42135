"""Conversation-log analytics on Spark.

Every public function takes and returns lazy DataFrames or Columns; nothing runs
until the caller writes or collects the result. The exceptions run a stream.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
