"""Operators for large-scale training-data pipelines.

Every operator is a function from DataFrames to a DataFrame.  ``queries()``
lists the thin ``opN_<name>`` queries that bind an operator to its table with
production parameters; ``oracle_sql()`` has their DuckDB equivalents where SQL
can express them.
"""
