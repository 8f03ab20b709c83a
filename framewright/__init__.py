"""Spark-native analytics over frame-indexed media annotation data."""
