"""Sources. Task functions are shipped by value, so executors need no install."""

from pyspark import cloudpickle

from firstseen.sources import content, tree, watch

for _module in (content, tree, watch):
    cloudpickle.register_pickle_by_value(_module)
