"""Spark-native knowledge, usage and training-data analytics."""
