"""Spark-native byte analytics, chunk dedup and archive engine."""

__version__ = "0.1.0"
