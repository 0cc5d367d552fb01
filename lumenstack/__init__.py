"""Spark-native analytics for image sequences and other dense, time-ordered arrays."""
