"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; ``queries.py`` and
``oracles.py`` hold its registered queries.
"""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so that a job needs no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
