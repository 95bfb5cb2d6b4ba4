"""Spark-native operators for building, labelling and evaluating document collections."""

__version__ = "0.1.0"
