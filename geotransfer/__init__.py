"""Spark-native analytics for point-footprint feature tables."""

__version__ = "0.1.0"
