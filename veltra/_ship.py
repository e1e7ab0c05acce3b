"""Workers get the package's functions by value, so executors need no copy of it."""

from pyspark import cloudpickle

import veltra

cloudpickle.register_pickle_by_value(veltra)
