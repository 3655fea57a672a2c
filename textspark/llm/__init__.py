"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` holds its
registered queries and the SQL that DuckDB can run against them.
"""
