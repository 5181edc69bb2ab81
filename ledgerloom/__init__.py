"""Invoice-to-ledger analytics on Spark: normalise, validate, reconcile, post and evaluate."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so that a job needs no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
