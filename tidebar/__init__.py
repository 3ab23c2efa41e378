"""Tidebar: market time series analytics on Spark DataFrames."""
