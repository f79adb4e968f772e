"""Training-data operators on Spark DataFrames.

Ten operators, one module each, and the queries that apply them to the
corpus tables. Nothing outside this subpackage imports it.
"""
