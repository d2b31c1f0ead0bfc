"""foldstream: online recommendation on Spark tables and streams."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks; executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
