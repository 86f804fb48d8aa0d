"""Spark-native analytics over collections of linked Markdown documents."""

__version__ = "0.1.0"
