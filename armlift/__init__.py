"""Armlift: analysis of large randomized experiments as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from armlift.schema import Roles

# helpers used inside tasks travel with the job: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Roles"]
