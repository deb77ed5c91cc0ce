"""Spark-native engine for ingesting, cleaning, matching, scoring and ranking text postings."""
