"""quarrylane: Spark-native analytics over collections of annotated documents."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# What Python workers run goes along with the job, so that executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
