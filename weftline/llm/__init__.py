"""Operators of a training-data pipeline: search, scans, deduplication, classifiers, mixing, tokens.

Nothing else in the library imports this subpackage.  Executors need not have
the package installed: functions sent to them carry the code of this subpackage.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
