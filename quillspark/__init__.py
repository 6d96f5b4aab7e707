"""Quillspark: a Spark-native engine for document collections: retrieval, deduplication, graphs and analytics."""

__version__ = "0.1.0"
