"""Diversity selection and descriptor analytics on Spark DataFrames."""

__version__ = "0.2.0"
