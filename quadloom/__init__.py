"""Spark-native spatial feature store and vector-tile engine."""
