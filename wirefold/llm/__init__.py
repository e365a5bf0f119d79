"""Operators for preparing training data: packing, formatting, scans, extraction, similarity joins, scoring.

Functions shipped to Spark's Python workers are pickled by value, so the
package need not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
