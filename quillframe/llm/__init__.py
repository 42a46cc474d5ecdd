"""Operators for large training corpora.  Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
