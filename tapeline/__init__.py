"""Spark-native analytics over recording archives and other logs of typed, timestamped records."""
