"""Operators for training-data pipelines.  Nothing outside this package imports it.

``queries.queries()`` and ``queries.oracle_sql()`` are what the entry module
registers; each operator module has its own general interface.
"""
