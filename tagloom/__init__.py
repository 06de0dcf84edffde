"""Typed-tag analytics on Spark: a small query language compiled to DataFrames."""
