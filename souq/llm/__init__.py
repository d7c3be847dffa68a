"""Operators for building training corpora (documents, pages, conversations, vectors).

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Python stages travel to the executors with their code, so nothing has to be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
