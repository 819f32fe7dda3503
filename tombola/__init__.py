"""Spark-native analytics for dated, multi-position number draws."""
