"""Hierarchy search, usage analytics and change-feed processing on Spark DataFrames."""
