"""Spark-native factor research and corpus processing engine."""

__version__ = "0.1.0"
