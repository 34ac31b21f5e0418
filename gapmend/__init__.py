"""gapmend: repair recommendation for large collections of time series, on Spark.

Every operator takes and returns DataFrames in long form, ``(dataset, series_id,
t, value)``, so that the work is partitioned and shuffled by Spark.
"""

import sys

from pyspark import cloudpickle

from gapmend.session import local_session

# helpers travel to the executors with the tasks, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["local_session"]
