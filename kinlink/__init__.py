"""Spark-native resolution of records of many sources."""
