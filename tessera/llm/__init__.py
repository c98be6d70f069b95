"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; numpy and Arrow are used inside tasks, on data that Spark has
partitioned.
"""
