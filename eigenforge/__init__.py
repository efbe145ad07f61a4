"""Significance testing of principal components on sparse count matrices, on Spark DataFrames."""

__version__ = "0.1.0"
