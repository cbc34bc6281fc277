"""Retrieval and data preparation over timed items, on DataFrames and Spark SQL."""
