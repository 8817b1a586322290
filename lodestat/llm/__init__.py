"""Training-data operators: tokenisation, token files, licence and toxicity scans,
language modelling and identification, near-duplicates, decontamination, main-text
extraction and exact search.  Nothing else in the library imports this package.

Functions of the package travel to executors by value, so a cluster needs no copy
of the repository on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
