"""Ordered, column-oriented analytics on Spark DataFrames."""
