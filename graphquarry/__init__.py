"""Spark-native analytics over source-code knowledge graphs."""

__version__ = "0.2.0"
