"""larkspan: lazy, composable DataFrame operators for retrieval, recommendation and corpus data.

Functions that run in Python workers are pickled by value, so executors need numpy, pandas and pyarrow but not this
package on their path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
