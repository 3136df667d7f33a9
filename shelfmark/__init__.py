"""Spark-native analytics over a layered knowledge library."""
