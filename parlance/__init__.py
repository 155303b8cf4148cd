"""Spark-native analytics over timed conversation records and text corpora."""
