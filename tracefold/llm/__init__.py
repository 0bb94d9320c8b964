"""Operators for preparing language-model training data.

Functions that run inside tasks travel with their code, so executors need
neither this package installed nor its folder on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
