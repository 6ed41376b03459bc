"""Sievewright: build, split, audit and freeze labelled-dataset manifests with Spark.

Every operator takes DataFrames and returns a DataFrame. What reaches the driver is
bounded: counts, one row a source or rule, samples of a stated size. What one task
holds is bounded too, but for the greedy folds, which hold the distinct group sizes or count
vectors, and an ungrouped rank of up to `sievewright.cell.rows` rows.
"""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with their tasks, so
# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
