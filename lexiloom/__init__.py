"""lexiloom: Spark-first building blocks for text and speech corpora."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors carry their code with them, so a job also runs
# where the package is installed on the driver alone.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
