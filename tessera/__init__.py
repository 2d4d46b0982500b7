"""Spark-native analytics engine for a small dynamically typed SQL dialect."""
