"""Spark-native analytics over property graphs, search indexes and change sets."""
