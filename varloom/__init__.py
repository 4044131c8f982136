"""Spark-native genomic interval and structural-variant analytics."""
