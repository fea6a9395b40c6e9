"""Spark-native corpus processing, retrieval and retrieval analytics."""
