"""Property-graph change logs as Spark jobs: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# the few Python functions that run in tasks travel with their code, so that
# executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
