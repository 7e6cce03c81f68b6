"""Spark-native auditing of large document corpora."""
