"""Payment-fraud scoring and its analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python operators travel to the executors with the job, so nothing has
# to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
