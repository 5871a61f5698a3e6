"""Log-stream analytics on Spark: one function per operator, from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

# The few Python functions that run on executors travel with the job, so that the package need not
# be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
