"""Spark-native analytics over time-varying networks.

A connectivity tensor is a long DataFrame ``(cond, subj, i, j, t, w)`` holding the
upper triangle ``i < j`` of every subject's graph at every frame; absent rows are 0.
"""

import sys

from pyspark import cloudpickle

from netweave.shape import TensorShape

# Kernels travel to the executors with the plan, so nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["TensorShape"]
