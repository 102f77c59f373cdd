"""Spark-native analytics for API traffic: admission, ingestion, roll-ups and reports over request hits."""
