"""Spark-native content analytics."""
