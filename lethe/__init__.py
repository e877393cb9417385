"""Spark-native data work around language-model unlearning benchmarks.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns.  Model outputs (token log-probabilities, generations, classifier
logits, linguistic annotations) enter as tables.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with their code, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
