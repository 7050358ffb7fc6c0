"""quarry: document retrieval and query-log analytics expressed as Spark DataFrame plans.

Every public function takes DataFrames (plus plain parameters) and returns a DataFrame.
Nothing is collected to the driver; all heavy work is joins, aggregations, windows and
Arrow-batched pandas functions that Spark partitions and shuffles.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package used inside Spark tasks (pandas UDFs, mapInPandas, stateful
# streaming) are shipped by value, so executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from quarry.session import get_session, shared_dir  # noqa: E402

__all__ = ["get_session", "shared_dir"]
