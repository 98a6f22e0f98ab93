"""Gridloom: Spark-native curation and analysis of sparse entity x item score data."""

__version__ = "0.1.0"
