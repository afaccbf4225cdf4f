"""vellum — scholarly-document analytics as Spark DataFrame jobs.

Every public function takes and returns ``pyspark.sql.DataFrame`` (or a
Column expression) so Catalyst plans the whole job: scans, filters,
joins, aggregations and iterative steps all run distributed.
"""

import sys

from pyspark import cloudpickle

# Worker functions travel with the code they call, so executors need no copy
# of this package on their path (no --py-files, no fixed working folder).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
