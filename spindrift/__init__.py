"""Hybrid document search and corpus analytics on Spark DataFrames."""

__version__ = "0.2.0"
