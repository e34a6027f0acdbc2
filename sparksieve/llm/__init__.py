"""Training-data operators over documents, conversations, pages and vectors.

Nothing outside this subpackage imports it.  Functions that run on executors
are shipped by value, so executors need numpy, pyarrow and the third-party
modules an operator names, but not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
