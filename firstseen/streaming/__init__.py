"""Streaming runs. Task functions are shipped by value, as in ``sources``."""

from pyspark import cloudpickle

from firstseen.streaming import dedup

cloudpickle.register_pickle_by_value(dedup)
