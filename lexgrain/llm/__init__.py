"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; `queries.py` holds the queries and
their SQL.  Each operator module states its method, its result for nulls, empty
and very long texts, ties, repeated rows and empty tables in its docstring.
"""
