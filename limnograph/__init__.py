"""Historic ranges, comparisons and trends of monitoring data, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from limnograph.engine import Monitor
from limnograph.plans.params import ReportParams
from limnograph.session import build_session

__all__ = ["Monitor", "ReportParams", "build_session"]

# Functions of this package travel to Python workers as they are; executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
