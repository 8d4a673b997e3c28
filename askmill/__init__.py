"""Developer-search analytics on Spark: term statistics, query generation, personalised search,
error queries, difficulty detection and telemetry, all as DataFrame operators."""

import sys

from pyspark import cloudpickle

from askmill.session import prepare

# Folds travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["prepare"]
