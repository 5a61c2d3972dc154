"""Warehouse inventory analytics on Spark DataFrames."""
