"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions that run on executors travel by value, so that executors need numpy, pyarrow and (for the
personal data) pyahocorasick, but
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
