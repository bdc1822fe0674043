"""scriptorium: DataFrame-first analytics for organisations, their sites and their publications."""

import sys

from pyspark import cloudpickle

# Executors need not have the library installed: functions that are sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
