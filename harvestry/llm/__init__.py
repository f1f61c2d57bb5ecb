"""Training-data pipeline operators: filters, deduplication, mixing, packing.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` binds them to the tables
of one folder, and ``corpus_pipeline`` (repository top) chains five of them.

Common rules, unless an operator's docstring says otherwise: a null text counts
as empty; every input row gives a row (repeated rows are not merged); input
columns that the operator does not name are ignored, so clashing names do not
matter; an empty table gives an empty result with the same schema.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that the workers
# need the third-party libraries but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
