"""Training-data operators: scoring, formatting, archives, packing, joins, search, mixing.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; numpy runs inside tasks on Arrow batches that Spark hands out.
"""
