"""lexsnap: regulation snapshots on Spark, from listing pages to cited context.

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
