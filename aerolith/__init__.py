"""Spark-native analytics for dense environmental sensor networks."""
