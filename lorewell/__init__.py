"""Spark-native retrieval and analytics over a corpus of typed notes."""
