"""Queries over the driver tables, one or more per operator, with SQL twins."""

import sys

from pyspark import cloudpickle

# The stand-in scorers run inside tasks and travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .registry import ORACLES, QUERIES  # noqa: E402
from . import quality, sampling, scalars, scoring, stats, storage  # noqa: E402, F401


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
