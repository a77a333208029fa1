"""Glossa: a Spark-native analytics engine for dictionaries and marked-up text."""
