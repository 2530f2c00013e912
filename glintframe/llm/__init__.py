"""Training-data operators: text, vector and web-archive processing on DataFrames.

Nothing outside this subpackage imports it.  ``queries.queries()`` and
``queries.oracle_sql()`` are what the entry module registers.
"""
