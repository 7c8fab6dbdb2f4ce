"""Company research tables on Spark: filings, calls, pages, replies and briefs."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors with the task, so
# the package has to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
