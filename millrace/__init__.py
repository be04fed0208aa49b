"""Spark-native curation and evaluation of fine-tuning data."""

__version__ = "0.1.0"
