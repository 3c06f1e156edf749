"""Spark-native analytics for synthetic-scene and rigid-body tables."""
