"""Estimator-bias audits on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the plan, so executors need no copy
# of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
