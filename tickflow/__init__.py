"""Ordered trade-event analytics on Spark DataFrames."""
