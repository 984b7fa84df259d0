"""Training-data operators: WARC derivatives, language-model scoring, deduplication,
packing, tokenisation, classifiers and quality rules.

Task functions of this subpackage are pickled by value, so executors need only the
third-party libraries, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
