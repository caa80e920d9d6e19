"""Batch and streaming song recommendations over users, songs and likes, on Spark DataFrames."""

__version__ = "0.1.0"
