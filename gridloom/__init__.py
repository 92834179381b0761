"""Spark-native analytics for gridded time series."""
