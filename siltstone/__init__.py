"""Spark-native retrieval engine over document collections."""
