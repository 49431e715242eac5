"""Tabular regression workbench on PySpark.

Every pass over rows is a Spark job; the driver only ever holds results whose size is fixed
by the schema or by an argument (one number per column, fold, component or program).
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
