"""Operators for preparing language-model training data.

Every module takes and returns DataFrames; ``registry`` holds the queries that
apply them to the driver tables.  Nothing outside this subpackage imports it.
"""
