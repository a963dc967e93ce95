"""Spark-native analytics for catalogs of events in space and time."""
