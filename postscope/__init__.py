"""Spark-native analytics over social-media posts and their embeddings."""

__version__ = "0.1.0"
