"""Document analytics on Spark: sections, alignment, chunks, retrieval, chat samples and quality rules as DataFrame operators."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers then need no copy of this package on their path
