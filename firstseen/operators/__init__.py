"""DataFrame -> DataFrame operators.

They run no action except row counts of staged tables, which come from footers.
"""
