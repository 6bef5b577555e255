"""Spark-native operators for dated image series, root geometry and growth tables."""

__version__ = "0.1.0"
