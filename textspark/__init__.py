"""Strict, lossless JSON, CSV and YAML processing on Spark DataFrames."""

__version__ = "0.1.0"
