"""Dataset intelligence on Spark: profile, clean, chart, test and question tables."""

import sys

from pyspark import cloudpickle

# Ship the few functions used in pandas UDFs by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
