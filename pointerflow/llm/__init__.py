"""Operators for building language-model training corpora with Spark.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames, selects only the columns it needs (so extra columns with clashing
names are harmless) and states its null and empty cases in its docstring.
"""
