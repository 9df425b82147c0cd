"""Spark-native catalog analytics: search, feeds, merges, extraction and ingest as DataFrame jobs."""
