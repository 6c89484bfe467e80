"""Operators for preparing training data, each a Spark job over whole tables.

Nothing outside this package imports it; `queries.py` registers one query per operator.
"""
