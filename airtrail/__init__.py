"""airtrail: Spark jobs for wireless and web traffic logs.

Every public function takes DataFrames (or Columns) and returns one; Catalyst plans the work.
"""

import sys

from pyspark import cloudpickle

# functions run in Python workers travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
