"""Spatial and measurement analytics on Spark DataFrames."""
