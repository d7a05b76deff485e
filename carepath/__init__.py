"""carepath: Spark-native analytics for coded event sequences with a text or vector modality."""

import sys

try:  # ship the package's functions inside tasks, so executors need no installed copy of it
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler: the package must then be installed on executors
    pass
