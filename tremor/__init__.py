"""Spark-native analytics for machining-vibration recordings."""

__version__ = "0.1.0"
