"""Operators over fact and binding tables: they take and return DataFrames."""
