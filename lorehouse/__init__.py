"""Spark-native knowledge retrieval and curation engine."""
