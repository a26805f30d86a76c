"""Spark-native analytics over customer-review snapshots."""
