"""weft: entity-resolution and matching analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
