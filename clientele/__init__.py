"""Customer-data analytics on Spark DataFrames.

Sub-packages
------------
functions   column expressions (money, text, vectors, nested arrays)
operators   DataFrame in, DataFrame out
sources     readers, writers and the adapter for the provided tables
streaming   the incremental versions, on Structured Streaming
plans       operators wired together: the dataset build and the questions
"""
