"""Spark-native search and investigation over large mail archives."""

__version__ = "0.1.0"
