"""Spark-native text-to-silver analytics."""
