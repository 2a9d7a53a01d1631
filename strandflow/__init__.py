"""Spark-native analytics for stranded sequence annotation and for text corpora."""
