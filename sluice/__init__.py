"""sluice: data pipelines, data quality, schema mapping and monitoring on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from sluice.session import build_session, scratch_path

# The few functions that run in Python workers travel with their code, so executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_path"]
