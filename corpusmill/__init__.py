"""Retrieval and corpus analytics on Spark DataFrames."""
