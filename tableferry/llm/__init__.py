"""Operations of a training-data pipeline over tables of texts.

Functions that run on executors are sent by value, so executors need numpy and pyarrow but not
this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
