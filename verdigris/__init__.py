"""Verdigris: a PySpark-native engine for retrieval, text structure and training-data work."""
