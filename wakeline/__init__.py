"""Vessel-voyage analytics as Spark DataFrame jobs.

Every public function takes DataFrames and returns DataFrames. Nothing in the
package pulls rows to the driver; the few eager steps write a small aggregate to
the shared stage folder and read its row count (see ``wakeline.session``).
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
