"""Runeworks: a Spark-native engine for few-shot puzzle data and the training sets built from it."""

__version__ = "0.1.0"
