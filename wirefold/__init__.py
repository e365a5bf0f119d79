"""wirefold — packet-capture labelling on Spark.

Captures are read as tables (one row per file, then one row per packet),
packets are filtered and rewritten with column expressions, turned into
fixed-length byte vectors, labelled by broadcast lookup joins, split into
stratified train/test sets with a keyed hash, scored and evaluated.
Every operator is a ``DataFrame -> DataFrame`` or ``Column -> Column``
function so it composes with ``DataFrame.transform``.
"""

import sys

from pyspark import cloudpickle

from wirefold.session import get_session, shared_dir, read_table

__all__ = ["get_session", "shared_dir", "read_table"]

# Functions shipped to Python workers are pickled by value: nothing has to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
