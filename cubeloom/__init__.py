"""Spark-native analytics for gridded space-time data."""

__version__ = "0.1.0"
