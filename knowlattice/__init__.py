"""Retrieval analytics and text processing on Spark DataFrames."""
