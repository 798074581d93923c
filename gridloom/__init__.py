"""Spark-native engine for chunked N-dimensional arrays and corpus tables."""

__version__ = "0.1.0"
