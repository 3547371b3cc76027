"""Sparse entity x feature count analytics on PySpark DataFrames."""
