"""Engram: a Spark-native engine for large collections of text-and-vector memories."""
