"""tessera: text-corpus analytics as Spark DataFrame operators.

Functions that tasks run are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
